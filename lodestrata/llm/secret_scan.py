"""Secret scans with ownership over the whole corpus.

Every text is searched once for the base kinds (assignments to telling names, access keys, long hexadecimal strings) and for
further candidates of any name: known credential formats and strings as random as keys are. Hashes of all candidates are
aggregated over the corpus by distinct texts, repositories and owners: what a good part of all owners and repositories has,
in different texts, is an example or a public constant; anything else looks live. So ownership decides which of the further
candidates become spans, and which of the base spans are redacted.

Only candidates' hashes and spans are shuffled, never texts. The counts combine in the tasks first, and go back to each
occurrence by hash and part, so that an example in a third of all texts is spread over PARTS tasks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

KINDS = ("assign", "access", "hex", "owned")  # in this order where spans start together
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_HEX_LONG = re.compile(r"[0-9a-f]{24}")
#: Published formats of credentials beyond the base kinds: version control, chat and payment tokens, JSON web tokens, PEM private keys.
_FORMATS = re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]{32,}-----END (?:[A-Z]+ )?PRIVATE KEY-----")


#: Strings that may be keys: of 20 characters or more, with letters in both cases and digits, and so many bits a character.
_RANDOM = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_DIGIT = re.compile(r"[0-9]")
LEAST_BITS = 3.5


def randomness(text: str) -> float:
    """Bits a character, by how often each one occurs."""
    n = len(text)
    return -sum(k / n * log2(k / n) for k in Counter(text).values())


def _as_random_as_keys(text: str) -> bool:
    return len(_DIGIT.findall(text)) >= 2 and text.lower() != text != text.upper() and randomness(text) >= LEAST_BITS


def find(text: str) -> list[tuple[int, int, int, str]]:
    """Start, kind (its place in KINDS), end and the secret itself, in order. Further candidates overlap no base span and no
    other one."""
    out = [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _HEX_LONG.search(text):
        out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    more = [(m.start(), 3, m.end(), m[0]) for m in _FORMATS.finditer(text)]
    more += [(m.start(), 3, m.end(), m[0]) for m in _RANDOM.finditer(text) if _as_random_as_keys(m[0])]
    if more:
        taken = bytearray(len(text))
        for start, _, end, _ in out:
            taken[start:end] = b"\1" * (end - start)
        for x in more:
            if taken.find(1, x[0], x[2]) < 0:
                taken[x[0] : x[2]] = b"\1" * (x[2] - x[0])
                out.append(x)
    return sorted(out)


PARTS = 32  # parts of a hash that very many occurrences may have
SPAN = "struct<start:int,kind:int,end:int,hash:bigint>"


def scan(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), most_owners: int = 3, most_repositories: int = 3, percent: int = 25) -> DataFrame:
    """doc_id, key (of the text), spans: of the base kinds all, of the others those that look live; each with n_owners,
    n_repositories and live: not both more than most_owners and `percent` of the corpus's owners, and more than
    most_repositories and `percent` of its repositories, have the secret. Equal texts count once, for their least owner and repository.

    A row for each row of docs. Null texts are empty; null owners and repositories count as one more each. Rows with equal
    doc_id and text have equal spans. Further columns are ignored; an empty table gives an empty result."""
    names = lambda cols: F.xxhash64(*(F.coalesce(F.col(x).cast("string"), F.lit("")) for x in cols))
    texts = docs.select("doc_id", c.text_key().alias("key"), names((owner,)).alias("owner"), names(repository).alias("repository"), "text")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"start": s, "kind": k, "end": e, "hash": xxhash.xxh3_64_intdigest(v) - (1 << 63)} for s, k, e, v in find(t.as_py() or "")] for t in b.column(4)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("hash", pa.int64())])))], names=["doc_id", "key", "owner", "repository", "spans"])

    found = c.materialize(texts.mapInArrow(search, f"doc_id bigint, key bigint, owner bigint, repository bigint, spans array<{SPAN}>"), "secrets")
    one = found.where("size(spans) > 0").select("doc_id", "key", "owner", "repository", F.explode("spans").alias("s"))
    owned = one.groupBy("s.hash", "key").agg(F.min(F.struct("owner", "repository")).alias("o")).select("hash", "o.owner", "o.repository").distinct()
    counts = owned.groupBy("hash").agg(F.countDistinct("owner").alias("n_owners"), F.countDistinct("repository").alias("n_repositories"))
    all_owners, all_repositories = found.agg(F.countDistinct("owner"), F.countDistinct("repository")).first()
    common = lambda n, most, total: F.col(n) > max(most, total * percent // 100)
    live = ~(common("n_owners", most_owners, all_owners) & common("n_repositories", most_repositories, all_repositories))
    part = F.pmod(F.xxhash64("doc_id", "key"), F.lit(PARTS)).cast("int")
    counts = counts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    rated = one.select("doc_id", "key", "s.*").distinct().withColumn("part", part).join(counts.hint("merge"), ["hash", "part"]).withColumn("live", live).where(f"live or kind < {KINDS.index('owned')}")
    rated = rated.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "n_owners", "n_repositories", "live"))).alias("spans"))
    rated = rated.withColumnsRenamed({"doc_id": "r_id", "key": "r_key"})
    out = found.select("doc_id", "key").join(rated, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("key") == F.col("r_key")), "left")
    return out.select("doc_id", "key", F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,kind:int,end:int,n_owners:bigint,n_repositories:bigint,live:boolean>>)")).alias("spans"))


def redact(docs: DataFrame, placeholder: str = "[secret]", **options) -> DataFrame:
    """docs with `placeholder` in place of each live secret's span, and n_chars (where docs has it) of the new texts. Every
    row stays; columns and their order stay."""
    live = scan(docs, **options).select("doc_id", "key", F.filter("spans", lambda s: s["live"]).alias("cut_spans")).where("size(cut_spans) > 0").distinct()
    live = live.withColumnsRenamed({"doc_id": "cut_id", "key": "cut_key"})
    # the row as one column, so that no name of docs clashes with another one
    own, text_key = F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("doc"), c.text_key().alias("text_key")
    joined = docs.select(own, F.col("doc_id").alias("row_id"), text_key).join(live, F.col("row_id").eqNullSafe(F.col("cut_id")) & (F.col("text_key") == F.col("cut_key")), "left")
    # spans that overlap are one; the text between the spans is kept, and what follows the last one
    old = F.col("doc.text")
    state = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    added = lambda s, x: F.when(x["start"] < s["at"], s["text"]).otherwise(F.concat(s["text"], F.substring(old, s["at"] + 1, x["start"] - s["at"]), F.lit(placeholder)))
    step = lambda s, x: F.struct(added(s, x).alias("text"), F.greatest(s["at"], x["end"]).alias("at"))
    done = lambda s: F.concat(s["text"], F.substring(old, s["at"] + 1, F.length(old)))
    joined = joined.withColumn("new_text", F.when(F.col("cut_spans").isNull(), old).otherwise(F.aggregate("cut_spans", state, step, done)))
    new = {"text": F.col("new_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("cut_spans").isNull(), F.col("doc.n_chars")).otherwise(F.length("new_text")).cast(docs.schema["n_chars"].dataType)
    return joined.select(*(new[x].alias(x) if x in new else F.col("doc")[x].alias(x) for x in docs.columns))


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kinds = F.array(*map(F.lit, KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < KINDS.index("owned"))
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"), live.alias("n_live"))

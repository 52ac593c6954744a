"""Stages of the pipeline on rows whose ids are missing or repeat."""

from collections import Counter

import corpus_pipeline


def words(n, seed):
    return " ".join(f"w{(k * 7919 + seed * 104729) % 100003}" for k in range(n))


ROWS = [(1, words(60, 1)), (1, words(60, 2)), (1, words(60, 1)), (2, words(60, 3)), (3, words(60, 1)), (None, words(60, 4)), (None, words(60, 5)), (None, words(60, 3)), (4, None), (None, words(60, 6))]
SCHEMA = "doc_id long, text string"


def test_near_duplicates_by_row(spark):
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(ROWS, SCHEMA).repartition(3), "")
    assert Counter(tuple(r) for r in got.collect()) == Counter([*ROWS[:2], ROWS[3], *ROWS[5:7], *ROWS[8:]])


def odd(spark):
    """Rows with columns of clashing names, a null in each column, equal ids and texts with other columns, empty and long texts."""
    names = "doc_id long, text string, lang string, source string, row string, row_key string, doc string, component_id string, cut_id string, n_chars long, `a.b` int"
    text = words(60, 1)
    rows = [(1, text, "en", "b", "mine", "k", "d", "c", "x", 5, 1), (1, text, "en", "a", "mine", "k", "d", "c", "x", 5, 1), (1, text, None, "a", None, None, None, None, None, None, None), (2, words(60, 7), "de", "a", "r2", "k", "d", "c", "x", 1, 2)]
    rows += [(3, None, None, None, "r3", None, None, None, None, None, None), (4, "", "en", "a", "r4", "k", "d", "c", "x", 0, 3), (None, words(40_000, 9), "en", "a", "r5", "k", "d", "c", "x", 9, 4), (5, words(50, 8) + " password=abcdefgh", "en", "a", "r6", "k", "d", "c", "x", 9, 4)]
    return spark.createDataFrame(rows, names).repartition(2), rows


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    spark.createDataFrame([(1, words(60, 7))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, rows = odd(spark)
    got = {stage: Counter(tuple(r) for r in f(spark, docs, str(tmp_path)).collect()) for stage, f in corpus_pipeline.STAGES[:4]}
    assert got["ngram_jaccard_join"] == Counter([rows[1], *rows[3:]])
    assert got["decontamination"] == Counter([*rows[:3], *rows[4:]])
    secret = rows[7][1].replace("password=abcdefgh", "[secret]")
    assert got["secret_scan"] == Counter([*rows[:7], (5, secret, *rows[7][2:9], len(secret), 4)])
    assert sum(got["quality_rules"].values()) == 6 and set(got["quality_rules"]) < set(rows)
    packed = corpus_pipeline.sequences(spark, docs, "").collect()
    assert sum(r.start == 0 for r in packed) == len(rows)
    for stage, f in corpus_pipeline.STAGES:
        none = f(spark, docs.where("false"), str(tmp_path))
        assert none.count() == 0 and (stage == "packing" or none.columns == docs.columns)


def test_keys_of_different_rows_differ(spark, monkeypatch):
    """With a first key of few bits, rows that clash get other keys."""
    from pyspark.sql import functions as F

    key = corpus_pipeline._key
    monkeypatch.setattr(corpus_pipeline, "_key", lambda seed, name: F.pmod(key(seed, name), F.lit(11)) if seed == 0 else key(seed, name))
    docs = spark.createDataFrame([(k // 2 if k % 5 else None, words(6, k)) for k in range(60)] + [(0, words(6, 1))] * 2, SCHEMA)
    keys = docs.select(corpus_pipeline.row_key(docs, "doc_id")).distinct().count()
    assert keys == docs.distinct().count()


def test_decontamination_by_row(spark, tmp_path):
    items = [(7, words(60, 2)), (None, words(60, 6)), (None, words(60, 5)), (8, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.decontamination(spark, spark.createDataFrame(ROWS, SCHEMA), str(tmp_path))
    assert Counter(tuple(r) for r in got.collect()) == Counter([ROWS[0], *ROWS[2:6], *ROWS[7:9]])


def test_pipeline_equals_plain_stages(spark, tmp_path):
    """All five stages on a small corpus, against sorted lists, all pairs, all windows and the tokenizer itself."""
    import re
    import zlib
    from collections import defaultdict

    import public_tokenizers
    from tokenizers import Tokenizer

    from lodestrata.llm import secret_scan
    from tests.llm.test_documents import components, plain_matches, plain_verdicts

    item = words(40, 900)
    docs = [(k, words(60 + k % 40, k), "en" if k % 3 else "de", f"s{k % 4}") for k in range(150)]
    docs += [(200 + k, words(60 + k, k), "en", "s1") for k in range(0, 30, 3)]  # copies
    docs += [(300 + k, docs[k][1].replace("w", "v", 2), "de", "s2") for k in range(0, 40, 4)]  # near copies
    docs += [(400 + k, words(30, 2000 + k) + " " + item + " " + words(20, 3000 + k), "en", "s3") for k in range(5)]  # of the benchmark
    docs += [(500 + k, words(50, 4000 + k) + f" password=own{k:05} api_key: shared99", "en", f"s{k % 4}") for k in range(12)]
    docs += [(600, "too short", "en", "s0"), (601, None, "en", "s0"), (602, "", None, None), (603, words(50, 77) + " " + "#" * 60, "en", "s1"), (604, " ".join(["again and again"] * 40), "en", "s1"), (605, words(3000, 5000), "en", "s1")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, words(30, 901))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = plain_verdicts(docs)
    left = [d for d in docs if kept[d[0]]]
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    group = components({d[0]: grams(d[1].split()) for d in left}, 80)
    left = [d for d in left if group[d[0]] == d[0]]
    bad = {d for d, _ in plain_matches([d[:2] for d in left], [(1, item), (2, words(30, 901))])}
    left = [d for d in left if d[0] not in bad]
    owners = defaultdict(set)
    for _, t, lang, source in left:
        for *_, value in secret_scan.find(t):
            owners[value].add(source)
    most = max(3, len({d[3] for d in left}) // 4)
    texts = {}
    for i, t, *_ in left:
        for value, own in owners.items():
            if len(own) <= most:
                t = re.sub(r"(password|api_key)[=:] ?" + value, "[secret]", t)
        texts[i] = t
    assert len(texts) < len(docs) - 20 and sum("[secret]" in t for t in texts.values()) == 12 and all("shared99" in t for i, t in texts.items() if 500 <= i < 512)

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for i, t in texts.items():
        ids, at = [*model.encode(t, add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            own = b"".join(x.to_bytes(4, "little") for x in ids[at : at + r.length])
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(own))
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048

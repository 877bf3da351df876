import corpus_pipeline
from pyspark.sql import functions as F

from curatrix.llm import decontaminate, pii, simhash
from curatrix.session import table

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_stages_one_after_another(spark):
    docs = table(spark, MIDDLE, "documents").withColumn("score", F.lit("own column"))
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], MIDDLE).cache())
    tox, near, clean, masked, last = seen[1:]
    for d in (tox, near, clean, masked):
        assert d.columns == docs.columns
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, MIDDLE, "labels").collect()}
    gone = {r["doc_id"] for r in docs.join(tox, "doc_id", "left_anti").collect()}
    assert len(gone) > 20 and sum(labels.get(i, 1) == 1 for i in gone) >= 0.95 * len(gone)
    groups = {}
    for r in tox.collect():
        groups[r["doc_id"]] = simhash.fingerprint(r["text"])
    kept = {r["doc_id"] for r in near.collect()}
    for i, f in groups.items():
        assert any((f ^ groups[k]).bit_count() <= 12 for k in kept)  # its group has a survivor
    assert not any((groups[a] ^ groups[b]).bit_count() <= 3 for a in kept for b in kept if a < b)
    gram = decontaminate.GramSet([(r["item_id"], r["text"]) for r in table(spark, MIDDLE, "benchmark").collect()], 10)
    rest = {r["doc_id"] for r in clean.collect()}
    for r in near.collect():
        assert (r["doc_id"] in rest) == (not gram.scan(decontaminate.words_of(r["text"]))[0].any())
    for r in masked.collect():
        assert not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
    assert last.count() == len(rest)


def test_empty_table(spark):
    docs = table(spark, SMALL, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0


def test_odd_rows_pass_through_all_stages(spark):
    """Nulls in any column, an empty text, a very long one, repeated rows, and columns named like the stages' own."""
    docs = table(spark, SMALL, "documents").limit(30)
    long_text = "a quiet sentence of plain words about nothing " * 4000
    odd = spark.createDataFrame([(None, None, None, None, None), (9001, None, "en", "s", None), (9002, "", "en", "s", 0), (9003, long_text, "en", None, len(long_text)), (9003, long_text, "en", None, len(long_text)), (9004, "write to jo@example.org", "en", "s", 23)], docs.schema)
    docs = docs.unionByName(odd).withColumns({"row": F.lit(1), "n_tokens": F.lit("own"), "component_id": F.lit("own"), "score": F.lit(2)})
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = stage(spark, docs, SMALL).cache()
        assert name == "bpe" or docs.columns == before
    got = {}
    for r in docs.collect():
        got.setdefault(r["doc_id"], []).append((r["n_tokens"], r["decoded"]))
    assert len(got[9003]) == 1 and got[9003][0][0] > 30000  # one of the two copies, whole
    assert "email" in got[9004][0][1] and "example" not in got[9004][0][1]
    # Null and empty texts have the same fingerprint, zero: one of their rows stays.
    assert [x for k in (None, 9001, 9002) for x in got.get(k, [])] == [(0, "")]


def test_token_stage_learns_nothing_from_the_texts(spark):
    """The last stage's table of words comes from the vocabulary: preparing it reads no document."""
    unread = spark.range(2).select(F.col("id").alias("doc_id"), F.raise_error(F.lit("read")).cast("string").alias("text"))
    name, stage = corpus_pipeline.STAGES[-1]
    assert name == "bpe" and stage(spark, unread, SMALL).columns == ["doc_id", "n_tokens", "ids", "decoded"]

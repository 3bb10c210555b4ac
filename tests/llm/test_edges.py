"""Nulls, empty tables, repeated rows, and extra columns of clashing names."""

import pytest
from pyspark.sql import functions as F

from sieveline.llm import conversations, decontamination, fingerprints, line_dedup, mixing, ngram_join, quality, sharding, token_counts, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["id", "n", "cls", "key", "keys", "a", "b", "pos", "line", "mask", "t", "h", "ws", "g", "cell", "shard", "slot", "part", "guest", "order", "score", "keep", "pattern", "toxic", "quality", "weight", "topic", "probability", "item_id", "root", "size"]


def counted(docs):
    import public_tokenizers

    return token_counts.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))


def items(spark):
    return spark.createDataFrame([(1, "five words are in here now"), (2, None), (None, "five words are in here now")], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, 1), (3, 0, None), (None, 1, 1), (1, 1, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "quality": lambda s, d: quality.score(d), "lines": lambda s, d: line_dedup.drop_frequent_lines(d), "mixing": lambda s, d: mixing.mix(d), "toxicity": lambda s, d: toxicity.tag(d, labels(s)),
    "ngrams": lambda s, d: ngram_join.near_duplicates(d), "tokens": lambda s, d: counted(d), "shards": lambda s, d: sharding.shard(d), "fingerprints": lambda s, d: fingerprints.fingerprints(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_clashing_columns(spark, name):
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (3, " \n\t ", None, "s", 4), (4, "Word", "en", "s", 4), (5, "word " * 40_000, "en", "s", 1), (6, "same text here for all", "de", "s", 2), (7, "same text here for all", "de", "s", 2), (7, "same text here for all", "de", "s", 2), (None, "no id at all", "en", "s", 3)]
    docs = spark.createDataFrame(rows, DOCS)
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit(f"extra {c}"))
    got = OPERATORS[name](spark, docs).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id for r in got), key=lambda i: (i is None, i)) == [1, 2, 3, 4, 5, 6, 7, 7, None]


def test_containment_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "so five words are in here now again"), (3, "so five words are in here now again"), (None, "FIVE words\nare in here now")], "doc_id long, text string").withColumn("id", F.lit(0)).withColumn("item_id", F.lit(0))
    got = {(r.doc_id, r.item_id, r.n_found) for r in decontamination.contained(docs, items(spark)).collect()}
    assert got == {(3, 1, 2), (None, 1, 2), (3, None, 2), (None, None, 2)}
    assert decontamination.contained(docs.limit(0), items(spark)).collect() == []
    assert decontamination.contained(docs, items(spark).limit(0)).collect() == []


def test_items_without_an_id_are_items_of_their_own(spark):
    bench = spark.createDataFrame([(None, "a b c d e f g h"), (None, "q r s t u v w x"), (5, "a b c d e f g h")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so a b c d e f g h then q r s t u v w x"), (2, "q r s t u v w x"), (3, " ".join(["z"] * 300_000) + " a b c d e f g h")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.item_id or 0, r.n_item, r.n_found) for r in decontamination.contained(docs, bench).collect()))
    assert got == [(1, 0, 4, 4), (1, 0, 4, 4), (1, 5, 4, 4), (2, 0, 4, 4), (3, 0, 4, 4), (3, 5, 4, 4)]


def test_conversation_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, None, None), (1, None, "user", "x"), (None, 0, "user", "a"), (None, 1, "user", "b"), (3, 0, "user", "a"), (4, 0, "user", "z"), (4, 0, "user", "y")]
    df = spark.createDataFrame(rows, schema)
    for c in ("a", "b", "k", "c", "block", "last", "kept", "n_logged"):
        df = df.withColumn(c, F.lit("extra"))
    got = {r.conv_id: (r.n_turns, r.chat) for r in conversations.render_maximal(df).collect()}
    assert got == {1: (2, "<|user|>\nx\n<||>\n\n"), None: (2, "<|user|>\na\n<|user|>\nb\n"), 4: (2, "<|user|>\ny\n<|user|>\nz\n")}
    assert conversations.render_maximal(spark.createDataFrame([], schema)).collect() == []
    long = spark.createDataFrame([(1, 0, "user", "x" * 3_000_000), (2, 0, "user", "x" * 3_000_000), (2, 1, "user", "y")], schema)
    assert [(r.conv_id, len(r.chat)) for r in conversations.render_maximal(long).collect()] == [(2, 3_000_021)]

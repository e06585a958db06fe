import re
import tempfile

from radiokpi.llm import rollups


def store(spark):
    return rollups.TokenRollup(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/rollup")


def totals(rollup):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["documents"], r["tokens"]) for r in rollup.totals().collect()}


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0d]+", text or ""))


def test_inserts_deletes_revisions_and_retries(spark, docs):
    texts = [("a b c", "s1"), ("d, e", "s1"), (None, None), ("f", "s2"), ("", "s2")]
    frame = docs([(k, t, s) for k, (t, s) in enumerate(texts)])
    rollup = store(spark)
    assert totals(rollup) == {}
    assert rollup.apply("1", rollups.changes(frame, "insert", rollups.WORDS))
    first = {("s1", "en", "words-1"): (2, 5), (None, "en", "words-1"): (1, 0), ("s2", "en", "words-1"): (2, 1)}
    assert totals(rollup) == first
    assert not rollup.apply("1", rollups.changes(frame, "insert", rollups.WORDS))
    rollup.apply("2", rollups.changes(frame, "insert", rollups.WORDS))  # equal entries again: no change
    assert totals(rollup) == first
    rollup.apply("3", rollups.changes(frame.where("doc_id in (0, 77)"), "delete", rollups.WORDS))
    rollup.apply("4", rollups.changes(frame.where("doc_id in (1, 3)"), "revise", rollups.PIECES))
    assert totals(rollup) == {("s1", "en", "pieces-2"): (1, 3), (None, "en", "words-1"): (1, 0), ("s2", "en", "pieces-2"): (1, 1), ("s2", "en", "words-1"): (1, 0)}
    assert rollup.apply("5", frame.limit(0).transform(lambda d: rollups.changes(d, "insert", rollups.WORDS)))
    assert totals(rollup.compacted(rollup.folder + "-2")) == totals(rollup)


def test_a_batch_that_broke_off_is_written_again(spark, docs):
    rollup = store(spark)
    change = rollups.changes(docs(["a b", "c"]), "insert", rollups.WORDS)
    rollup.apply("1", change)
    change.where("doc_id = 0").write.parquet(f"{rollup.folder}/deltas/batch=2")  # remains of a lost driver
    assert totals(rollup) == {("src0", "en", "words-1"): (1, 2), ("src1", "en", "words-1"): (1, 1)}
    assert rollup.apply("2", rollups.changes(docs(["x y z"]), "revise", rollups.WORDS))
    assert totals(rollup)[("src0", "en", "words-1")] == (1, 3)


def test_the_last_change_of_a_document_counts(spark, docs):
    rollup = store(spark)
    one, two = docs([(1, "a", "s")]), docs([(1, "a b", "s")])
    change = rollups.changes(one, "insert", rollups.WORDS, 0).union(rollups.changes(two, "revise", rollups.WORDS, 1))
    rollup.apply("1", change.union(change))
    assert totals(rollup) == {("s", "en", "words-1"): (1, 2)}


def test_awkward_rows(spark, docs, awkward):
    rollup = store(spark)
    rows = [t if isinstance(t, tuple) else (k, t, "s") for k, t in enumerate(awkward)]
    rollup.apply("1", rollups.changes(docs(rows), "insert", rollups.WORDS))
    last = {t[0]: t for t in rows}
    assert sum(n for n, _ in totals(rollup).values()) == len(last)
    assert sum(t for _, t in totals(rollup).values()) == sum(words(t[1]) for t in last.values())

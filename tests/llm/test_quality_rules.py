import re
from collections import Counter

from tessera.llm import quality_rules as Q

SF = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(Q.SYMBOLS, text)), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_brute_force(spark):
    texts = [None, "", " \n\t ", "a", "a b", "a b c a b c", "x " * 500, "é日 b c\x0bd\x0ce\rf", "l1\nl1\n \n \nl1 \nl1", "a b c d a b c", "### $ <b>|"]
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)] + [(None, "a b c", "old"), (1, "a", "old")], "doc_id long, text string, n_words string")
    for r in Q.statistics(docs).collect():
        assert tuple(r[k] for k in Q.BASE) == brute(r.text)
    docs = Q.load(spark, SF, "documents")
    for r in Q.statistics(docs).collect():
        assert tuple(r[k] for k in Q.BASE) == brute(r.text)
    assert Q.statistics(docs.limit(0)).count() == 0


def test_learned_list_is_accurate_and_equals_its_expression(spark):
    docs, labels = Q.load(spark, SF, "documents"), Q.load(spark, SF, "labels")
    rules = Q.fit(docs, labels)
    assert rules.rules
    got = {r.doc_id: r for r in Q.op4_quality_rules(spark, SF).collect()}
    judged = [(got[x.doc_id], x.quality) for x in labels.collect() if not got[x.doc_id].base_failed]
    assert sum(r.kept == (q == 1) for r, q in judged) >= 0.95 * len(judged)
    rows = Q.statistics(docs).select("doc_id", *[v.alias(k) for k, v in Q.features().items()]).collect()
    for r in rows:
        assert got[r.doc_id].kept == (not got[r.doc_id].base_failed and rules.accepts_row(r.asDict()))


def test_learning_grows_and_prunes_conjunctions():
    rows = [{"a": i % 10, "b": i // 10 % 10, "bad": i % 10 >= 7 and i // 10 % 10 < 3, "fold": i % 3} for i in range(900)]
    rules = Q.learn(rows)
    assert all(rules.accepts_row(r) is not r["bad"] for r in rows)
    assert {c.feature for rule in rules.rules for c in rule} == {"a", "b"}
    assert Q.learn([]).rules == ()


def test_without_labels_the_base_rule_decides(spark):
    docs = spark.createDataFrame([(1, "w%d " * 60 % tuple(range(60))), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rules = Q.fit(docs, labels)
    assert rules.rules == ()
    assert {r.doc_id: r.kept for r in Q.judge(docs, rules).collect()} == {1: True, 2: False}

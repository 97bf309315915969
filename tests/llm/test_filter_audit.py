"""The filter audit against a walk of every document through every order."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from tests.llm.fixtures import documents, edge_documents
from tidemark.llm import filter_audit

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_audit(docs, labels):
    """One document after the other, filter after filter, for each of the 120 orders."""
    good, toxic, firsts = set(), set(), {}
    for r in labels:
        good |= {r.doc_id} if r.quality == 1 else set()
        toxic |= {r.doc_id} if r.toxic == 1 else set()
    for r in docs:
        if r.doc_id is not None:
            firsts[r.text or ""] = min(r.doc_id, firsts.get(r.text or "", r.doc_id))
    marked = []
    for r in docs:
        text = r.text or ""
        words = WORD.findall(text)
        fails = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
        fails += "E" * (r.doc_id is not None and r.doc_id > firsts[text])
        known = r.doc_id is not None
        marked.append((r.source or "", fails, known and r.doc_id in good, known and r.doc_id in toxic))
    out, shapley = {}, Counter()
    for part in {m[0] for m in marked}:
        own = [m for m in marked if m[0] == part]
        for order in permutations("ABCDE"):
            alive = own
            for step, f in enumerate(order, 1):
                gone = [m for m in alive if f in m[1]]
                alive = [m for m in alive if f not in m[1]]
                fails = sum(f in m[1] for m in own)
                out[part, "".join(order), step] = [len(alive), len(gone), fails - len(gone), sum(m[1] == f for m in own), sum(m[2] for m in gone), sum(m[3] for m in gone)]
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def as_dict(rows):
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(got) == len(rows)
    return got


def test_audit_equals_a_walk_over_documents_and_edge_rows(spark):
    docs = documents(spark, SF).unionByName(edge_documents(spark).select("doc_id", "text", "source", "lang", "n_chars"))
    # Copies: of a text, with a null id, in another source, of an empty text.
    text = docs.where("doc_id = 3").first().text
    more = [(900, text, "other", "en", 1), (901, text, None, "en", 1), (None, text, "other", "en", 1), (901, text, None, "en", 1), (902, None, "src1", "en", 0)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    extra = [(-8, 1, 1), (-8, 0, 0), (900, 1, None), (901, None, 1), (None, 1, 1), (10**9, 1, 1), (-1, None, None)]
    labels = labels.unionByName(spark.createDataFrame(extra, "doc_id long, quality int, toxic int"))
    got = as_dict(filter_audit.audit_documents(docs, labels).collect())
    assert got == slow_audit(docs.collect(), labels.collect())
    assert len(got) == 600 * len({k[0] for k in got})


def test_audit_reads_named_columns_only_and_takes_empty_tables(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = edge_documents(spark).selectExpr("*", "1 as part", "2 as mask", "3 as n", "4 as id", "5 as digest", "6 as quality", "7 as toxic", "8 as salt")
    got = as_dict(filter_audit.audit_documents(docs, labels).collect())
    assert got == slow_audit(docs.collect(), labels.collect())
    assert filter_audit.audit_documents(docs.limit(0), labels).count() == 0
    assert as_dict(filter_audit.audit_documents(docs, labels.limit(0)).collect()) == slow_audit(docs.collect(), [])


def test_ids_may_be_text(spark):
    docs = spark.createDataFrame([("b", "x y", "s"), ("a", "x y", "s"), (None, "x y", "s")], "doc_id string, text string, source string")
    labels = spark.createDataFrame([("b", 1, 0)], "doc_id string, quality int, toxic int")
    got = as_dict(filter_audit.audit_documents(docs, labels).collect())
    assert got == slow_audit(docs.collect(), labels.collect())
    assert got["s", "EABCD", 1][:6] == (2, 1, 0, 0, 1, 0)


def test_labels_are_not_broadcast(spark):
    rows = spark.createDataFrame([(1, b"a", "p", 0, 2), (1, b"b", "p", 1, 1), (None, b"a", "q", 0, 1)], "id long, digest binary, part string, mask int, n long")
    # Ids 0 to 2 and none: few rows by Spark's estimate.
    labels = spark.range(4).selectExpr("if(id = 3, null, id) as doc_id", "1 as quality", "if(id = 1, null, 1) as toxic")
    out = filter_audit.label_flags(rows, labels, ["quality", "toxic"])
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.part, r.mask, r.quality, r.toxic) for r in out.collect()) == [("p", 0, 1, 0), ("p", 1, 1, 0), ("q", 0, 0, 0)]


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5])
def test_intervals_cover_each_removal_once(k):
    by = defaultdict(Counter)
    for mask, step, begin, end in filter_audit.removal_intervals(k):
        assert begin < end
        by[mask].update((rank, step) for rank in range(begin, end))
    for mask in range(1, 1 << k):
        want = Counter()
        for rank, order in enumerate(permutations(range(k))):
            want[rank, 1 + next(i for i, f in enumerate(order) if mask >> f & 1)] += 1
        assert by[mask] == want


def test_fewer_filters_and_wrong_names(spark):
    counts = spark.createDataFrame([("p", 0, 5), ("p", 1, 2), ("p", 3, 1)], "part string, mask int, n long")
    rows = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filter_audit.audit_orders(counts, "xy", ["n"]).collect()}
    assert rows == {("xy", 1): (5, 3, 0, 2, 5), ("xy", 2): (5, 0, 1, 0, 1), ("yx", 1): (7, 1, 0, 0, 1), ("yx", 2): (5, 2, 1, 2, 5)}
    with pytest.raises(ValueError):
        filter_audit.audit_orders(counts, "yx", ["n"])

from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from phrasewerk.llm import terms

ENTRIES = "entry_id long, process_name string, phrase string, documents array<struct<id:string,offsets:array<array<int>>>>, term string"
CONFIG = "process_name string, config struct<data:struct<case_sensitive:boolean,tfidf_filter:struct<enabled:boolean,min_df:long,max_df:double>>>"


def config(spark):
    return spark.createDataFrame([("a", ((None, (True, 2, 0.5)),)), ("b", ((True, (True, 1, 0.9)),)), ("c", ((False, (False, 1, 0.1)),))], CONFIG)


entry = st.tuples(
    st.integers(1, 6), st.sampled_from(["a", "b", "c", "d"]), st.sampled_from([None, "", "..", "Herz", "herz", "Herz 2"]),
    st.none() | st.lists(st.none() | st.tuples(st.sampled_from([None, "x", "y", "z"]), st.none() | st.lists(st.tuples(st.integers(0, 2), st.integers(3, 4)).map(list), max_size=2)), max_size=3),
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(entry, max_size=25), st.integers(1, 4))
def test_against_brute_force(spark, entries, partitions):
    df = spark.createDataFrame([(*e, "clash") for e in entries] * 2, ENTRIES)
    got = {(r.process_name, r.term): (r.n_occurrences, r.n_documents) for r in terms.term_counts(terms.term_rows(df, config(spark)), partitions).collect()}
    places, docs, seen = defaultdict(set), defaultdict(set), set()
    for i, p, phrase, ds in entries:
        if p not in "ab" or not phrase or not any(c.isalnum() for c in phrase):
            continue
        key = (p, phrase if p == "b" else phrase.lower())
        seen.add(key)
        for d in ds or []:
            if d is not None and d[0] is not None:
                docs[key].add(d[0])
                places[key] |= {(i, d[0], o[0]) for o in d[1]} if d[1] else {(i, d[0], None)}
    assert got == {k: (len(places[k]), len(docs[k])) for k in seen}


def test_marks(spark):
    counts = spark.createDataFrame([("a", "t1", 5, 1), ("a", "t2", 5, 2), ("a", "t3", 9, 3), ("b", "t", 0, 0)], "process_name string, term string, n_occurrences long, n_documents long")
    files = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("a", 3), ("a", 4)], "process_name string, file_id long")
    got = {r.term: r.mark for r in terms.marked(counts, files, config(spark)).collect()}
    assert got == {"t1": "rare", "t2": None, "t3": "common", "t": "rare"}

"""Queries on empty tables and on rows of nulls end with a defined result."""

import pytest

from phrasewerk.plans import catalog

#: One of each kind of operator; the rest share their code.
NAMES = [
    "prj01_lines", "ag01_affirmed_provenance", "ag03_affirmed_counts", "ag05_min_max", "wn02_phrase_ids", "neg05_boundaries", "ag01_negated_reset", "prj06_view_topics", "prj15_corpus_statistics", "snk02_processed_lines",
    "gr01_phrase_graph", "gr02_merged_phrases", "gr05_graph_nodes", "gr07_simplified", "gr08_components", "gr09_significance", "gr10_page_rank", "gr11_unrolled", "gr12_sub_clusters", "gr14_path_scores", "gr15_community_scores", "ag08_concept_scores",
    "vs07_predicted_graphs", "vs03_duplicates", "vs04_updated", "vs08_added_document", "ag19_merged_provenance", "jn12_upserted_phrases", "gr19_document_removed", "ag10_purity", "ag11_adjusted_rand", "tk01_top_cosine", "ml04_k_means", "ml04_mini_batch", "ml06_chosen_k",
    "ml01_encoded", "rg01_runs", "rg02_packed_chunks", "rg07_hybrid", "rg08_snippets", "rg11_answers", "qe01_candidates", "qe05_expanded", "sc14_clean_answers", "pc07_latest_status", "st_windowed_counts",
]


@pytest.mark.parametrize("name", NAMES)
def test_empty_and_null_rows(spark, odd_tables, name):
    for folder in odd_tables:
        rows = catalog.QUERIES[name](spark, folder)
        assert len(rows.columns) > 0 and rows.count() >= 0

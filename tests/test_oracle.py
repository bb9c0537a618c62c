import pytest

from dunecorpus.plans import registry
from tests.oracle import differences

SF = "/root/testdata/sf0.001"
#: Queries that SQL can't express; test_plain.py, test_walks.py, test_language.py and test_growing.py hold them against plain versions.
PLAIN = {"c1_nfkc", "c7_repeated_phrases", "c8_repeated_words", "c_comment_pipeline", "c_forum_pipeline", "d2_minhash", "d4_near_duplicates", "i1_incremental", "i3_persisted_index", "m3_hidden_states", "m6_machines", "m7_kmeans", "p20_hash_buckets", "a39_subword_fertility", "a41_round_trips", "a42_pieces", "m13_hashed_classifier", "m21_generate", "m27_like_contexts", "m6_sparse_machines"}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    assert differences(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF) is None


def test_every_query_is_held_against_something():
    assert set(registry.queries()) == set(registry.oracle_sql()) | PLAIN and not PLAIN & set(registry.oracle_sql())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""References of the quality rules: texts of no language, and common words as they stand in running text."""

import random

from matchlake.llm.quality import features, quality_rules

SCHEMA = "doc_id long, text string, lang string"


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "house", "river", "in", "garden", "to", "morning"]) for _ in range(n))


def test_a_text_of_no_language_is_not_its_own_reference(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, 120), "en") for i in range(60)]
    rows += [(100, " ".join(f"#{rng.randrange(10**6)}%$" for _ in range(120)), None), (101, prose(rng, 120), None), (102, prose(rng, 120), "xx")]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not kept.pop(100) and all(kept.values())


def test_common_words_count_in_capitals_and_beside_marks(spark):
    row = features(spark.createDataFrame([(1, 'The house, "and" (of) it; THE. theory', "en")], SCHEMA)).first()
    assert sorted(row["listed"]) == ["and", "it", "of", "the", "the"] and row["common"][-1] == 2


def test_only_texts_without_language_or_none_at_all(spark):
    rng = random.Random(8)
    assert all(r["kept"] for r in quality_rules(spark.createDataFrame([(i, prose(rng, 80), None) for i in range(5)], SCHEMA)).collect())
    assert quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0
    assert not quality_rules(spark.createDataFrame([(1, None, None), (2, "", "en")], SCHEMA)).where("kept").count()

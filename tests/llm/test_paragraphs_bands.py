from fairlane.llm import paragraphs


def test_bands_lose_at_most_a_fiftieth_of_the_pairs_at_the_threshold():
    assert (1 - 0.8 ** paragraphs.ROWS) ** paragraphs.BANDS <= 0.02

from broadsheet.functions.lexicon import DEFAULT_LEXICON
from broadsheet.operators.relevance import (
    keyword_frequency, relevance_gate, relevance_score, score_by_table,
)

LEX = [("river", 3.0), ("flood", 2.0), ("town hall", 2.0), ("top-ten", 1.0), ("route 9", 1.0)]

CASES = [
    ({"url": "a", "title": "River river RIVER", "description": None}, 3.0),
    ({"url": "b", "title": "by the town", "description": "hall of fame"}, 2.0),
    ({"url": "c", "title": "rivers flooded", "description": ""}, 0.0),
    ({"url": "d", "title": "ériver flood!", "description": "_flood"}, 2.0),
    ({"url": "e", "title": None, "description": None, "source": "Flood", "author": "River"}, 5.0),
    ({"url": "f", "title": "top-ten", "description": "route 9, route 99"}, 2.0),
    ({"url": "g", "title": "town  hall", "description": "top ten"}, 0.0),
    ({"url": "h"}, 0.0),
]


def test_scores(articles, rows):
    df = articles(*[c for c, _ in CASES])
    want = sorted((c["url"], s) for c, s in CASES)
    assert rows(relevance_score(df, LEX), "url", "relevance_score") == want


def test_table_lexicon_gives_the_same(spark, articles, rows):
    df = articles(*[c for c, _ in CASES])
    table = spark.createDataFrame([(k, "t", w) for k, w in LEX], "keyword string, tier string, weight double")
    assert rows(score_by_table(df, table), "url", "relevance_score") == rows(
        relevance_score(df, LEX), "url", "relevance_score"
    )


def test_both_ways_agree_on_tiers_repeats_and_nulls(spark, articles):
    df = articles({"url": "a", "title": "river !! the end"}, {"url": "a", "title": "end"}, {"url": None, "title": "the river"}, {"url": None})
    lexicon = [("river", 2.0, "one"), ("River", 2.0, "two"), ("!!", 9.0, "one"), ("the end", 1.0, "one"), ("the river", 4.0, "one")]
    table = spark.createDataFrame([(k, t, w) for k, w, t in lexicon], "keyword string, tier string, weight double")
    for scored in (relevance_score(df, lexicon), score_by_table(df, table)):
        assert sorted((str(r.url), r.relevance_score) for r in scored.collect()) == [("None", 0.0), ("None", 8.0), ("a", 0.0), ("a", 5.0)]


def test_keyword_of_two_tiers_counts_for_both(articles):
    df = articles({"url": "a", "title": "river"})
    assert relevance_score(df, [("river", 3.0), ("river", 1.0), ("River", 3.0)]).first().relevance_score == 4.0


def test_gate_is_inclusive(articles, rows):
    df = articles(*[c for c, _ in CASES])
    assert [u for (u,) in rows(relevance_gate(df, 2.0, LEX), "url")] == ["a", "b", "d", "e", "f"]


def test_frequency_has_no_zero_rows(articles, rows):
    df = articles(*[c for c, _ in CASES])
    assert rows(keyword_frequency(df, LEX), "keyword", "articles") == [
        ("flood", 2), ("river", 2), ("route 9", 1), ("top-ten", 1), ("town hall", 1),
    ]


def test_default_lexicon_total():
    assert len(DEFAULT_LEXICON) == 61
    assert sum(w for _, w in DEFAULT_LEXICON) == 113.0


def test_matching_is_planned_once(articles, plan):
    df = relevance_gate(articles({"url": "a"}).repartition(2), 2.0, LEX).filter("category = 'x'")
    text = plan(df)
    assert text.count("split(lower") == 1
    assert "Python" not in text


def test_a_text_is_put_together_no_more_often_for_a_larger_lexicon(articles, plan):
    lexicon = [*LEX, *((f"the flood{i}", 1.0) for i in range(30))]
    assert plan(relevance_score(articles({"url": "a"}), lexicon)).count("concat_ws(") == 2


def test_guards_hide_no_phrase(articles, rows):
    df = articles({"url": "a", "title": "x -ray! été-là é_2 b", "description": "c++ ok"}, {"url": "b", "title": "x-ray été là é_ 2", "description": "c ++"})
    lexicon = [("-ray!", 1.0), ("été-là", 2.0), ("é_2 b", 4.0), ("c++", 8.0), ("x -ray", 16.0), ("-", 32.0), ("a b", 64.0)]
    assert rows(relevance_score(df, lexicon), "url", "relevance_score") == [("a", 31.0), ("b", 0.0)]

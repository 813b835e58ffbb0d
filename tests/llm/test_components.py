"""Components: new links are added to earlier stars, and stars are told without a step."""

from cartlake.llm import components as module
from cartlake.llm.staging import staged


def test_stars_need_no_step(spark, monkeypatch):
    labels = []
    monkeypatch.setattr(module, "staged", lambda df, label: labels.append(label) or staged(df, label))
    stars = spark.createDataFrame([(5, 1), (7, 1), (9, 2), (9, 9)], "a long, b long")
    assert {tuple(r) for r in module.components(stars).collect()} == {(5, 1), (7, 1), (9, 2)} and labels == ["links"]
    more = stars.unionByName(spark.createDataFrame([(7, 9), (11, 12), (12, 13)], "a long, b long"))
    assert {tuple(r) for r in module.components(more).collect()} == {(2, 1), (5, 1), (7, 1), (9, 1), (12, 11), (13, 11)}

"""Few links and labels are not dealt out again: stages of the near duplicates and of components."""

import random

from pingscape.llm import graph, near_dedup


def stages(spark, run):
    """What `run` gives and the stages of its jobs, those that were skipped included."""
    context = spark.sparkContext
    group = f"stages-{random.random()}"
    context.setJobGroup(group, group)
    try:
        found = run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    return found, sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(group))


def test_few_labels_are_broadcast(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201)]
    links = spark.createDataFrame(chain, "a long, b long")
    labels, count = stages(spark, lambda: graph.components(links, "a", "b"))
    assert {r["node"]: r["label"] for r in labels.collect()} == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200}
    more = spark.createDataFrame([(201, 300), (300, 5), (400, 401)], "a long, b long")
    whole = {r["node"]: r["label"] for r in graph.relabelled(labels, more).collect()}
    assert whole == {**{i: 0 for i in range(41)}, 100: 0, 200: 0, 201: 0, 300: 0, 400: 400, 401: 400}
    print("stages of components", count)
    assert count < 60


def test_sets_and_pairs_are_stored_once(spark):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = [[draw.choice(words) for _ in range(60)] for _ in range(20)]
    rows = []
    for k, text in enumerate(texts):
        for copy in range(3):
            own = list(text)
            if copy:
                own[draw.randrange(60)] = f"x{copy}"
            rows.append((3 * k + copy, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found, count = stages(spark, lambda: near_dedup.near_duplicates(spark, docs).collect())
    assert {r["doc_id"]: r["component_id"] for r in found} == {d: d // 3 * 3 for d, _ in rows}
    print("stages of near duplicates", count)
    assert count < 115

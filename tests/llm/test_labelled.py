"""Samples of labelled documents."""

from srcframe.llm import labelled


def test_labels_of_absent_documents_use_up_nothing(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(0, 4000, 100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i // 100 % 2) for i in range(4000)], "doc_id long, toxic int")
    few, sizes = labelled.sample(docs, labels, "toxic", 10)
    fit = [r.doc_id for r in docs.filter(labelled.fold(docs.doc_id) != 2).collect()]
    assert sizes == {y: sum(i // 100 % 2 == y for i in fit) for y in (0, 1)}
    assert few.groupby("y").size().to_dict() == {0: min(10, sizes[0]), 1: min(10, sizes[1])}
    assert all(few.text == "text " + few.doc_id.astype(str))


def test_sample_is_bounded_in_bytes():
    import random

    from srcframe.llm.labelled import _Within
    rows = [(random.Random(k).randrange(-10**6, 10**6), (k, "x" * (k * 37 % 200), 0)) for k in range(300)]
    want, size = [], 0
    for order, row in sorted(rows):
        size += len(row[1])
        if size > 5000 and want:
            break
        want.append(row)
    random.Random(1).shuffle(rows)
    kept = _Within(5000)
    for order, row in rows:
        kept.add(order, row)
    assert sorted(x[4] for x in kept.heap) == sorted(want)

from radiokpi.llm import mixing


def test_targets_against_the_stated_rule(spark):
    sizes = {"a": 10, "b": 1000, "c": 40, "d": 7, None: 300}
    names = sorted(n for n in sizes if n) + [None]
    weight = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    target, free, rest = {}, set(names), float(sum(sizes.values()))
    while True:
        level = rest / sum(weight[n] for n in free)
        over = [n for n in free if level * weight[n] > 3 * sizes[n]]
        if not over:
            break
        for n in over:
            target[n] = 3.0 * sizes[n]
            rest -= target[n]
            free.discard(n)
    target |= {n: level * weight[n] for n in free}
    frame = spark.createDataFrame([(n or "null", n, s) for n, s in sizes.items()], "__source string, source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
    assert all(abs(got[n] - target[n]) < 1e-9 for n in names)


def test_mix_keeps_every_row_and_nears_targets(docs):
    texts = [(k, "w " * (1 + k % 7), "hot" if k % 3 else f"s{k % 5}") for k in range(3000)]
    got = mixing.mix(docs(texts)).collect()
    assert len(got) == 3000 and all(0 <= r["__copies"] <= 3 for r in got)
    assert {r["doc_id"]: r["__size"] for r in got} == {k: 1 + k % 7 for k in range(3000)}
    for source in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == source]
        taken = sum(r["__copies"] * r["__size"] for r in mine)
        assert abs(taken - mine[0]["__target"]) <= 10
    again = {r["doc_id"]: r["__copies"] for r in mixing.mix(docs(texts[::-1])).collect()}
    assert again == {r["doc_id"]: r["__copies"] for r in got}


def test_awkward_rows_and_columns(docs, awkward):
    frame = docs(awkward)
    got = mixing.mix(frame).collect()
    assert len(got) == len(awkward)
    assert all(r["__copies"] * r["__size"] <= 3 * r["__size"] for r in got)
    mixed = mixing.mixed_documents(frame)
    assert mixed.columns == frame.columns
    assert mixed.count() == sum(r["__copies"] for r in got)
    assert mixing.mix(docs([])).count() == 0
    assert mixing.mixed_documents(docs([None, ""])).count() == 0

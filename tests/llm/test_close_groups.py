from voxlake.llm.neardup import candidate_groups, groups_by_distance


def test_close_fingerprints_are_candidates_without_a_shared_minimum(spark):
    prints = {"a": 0, "b": 0b111, "c": 0b111 << 6, "d": (1 << 128) - 1, "e": (1 << 128) - 1, "f": 0xFFFFFF << 60}
    schema = "fp binary, print binary, size long, minima array<bigint>, few array<bigint>, first struct<none: boolean, doc_id: long, row_id: long>"
    rows = [(k.encode(), p.to_bytes(16, "big"), 100, [ord(k) * 10 + i for i in range(10)], [], (False, ord(k), ord(k))) for k, p in prints.items()]
    classes = spark.createDataFrame(rows, schema)
    of = {}
    for r in groups_by_distance(classes.select("fp", "print"), 8).collect():
        of.setdefault(bytes(r["comp"]), set()).add(bytes(r["fp"]).decode())
    assert sorted(map(sorted, of.values())) == [["a", "b", "c"], ["d", "e"], ["f"]]
    found = {bytes(r["fp"]).decode() for r in candidate_groups(classes, 0.8).collect()}
    assert {"a", "b", "c", "d", "e"} <= found

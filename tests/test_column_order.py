from collections import defaultdict

from quarry.operators import profile


def brute(rows):
    """(snapshot, column) in order of the first (record number, place) that has it, nulls first."""
    first = {}
    for snap, number, keys in rows:
        for pos, k in enumerate(keys):
            at = (number is not None, number or 0, pos, k)
            first[snap, k] = min(first.get((snap, k), at), at)
    out, seen = [], defaultdict(int)
    for (snap, k), _ in sorted(first.items(), key=lambda x: (str(x[0][0]), x[1])):
        seen[snap] += 1
        out.append((snap, k, seen[snap]))
    return sorted(out, key=str)


def records(spark, rows):
    text = [(s, n, "{" + ",".join(f'"{k}":{i}' for i, k in enumerate(keys)) + "}") for s, n, keys in rows]
    return spark.createDataFrame(text, "snapshot_id string, record_number long, payload string")


def test_order_of_odd_records(spark):
    top = (1 << 63) - 1
    rows = [("a", 2, "cb"), ("a", 1, "bd"), ("a", 3, "ead"), ("b", None, "yx"), ("b", -(1 << 63), "zxy"), ("b", top, "wz"),
            ("c", top, "ba"), ("c", top - 1, "cc"), ("d", 5, "kmk"), ("d", 5, "m"), ("e", 1, ""), (None, 1, "qp"),
            ("f", 1, ("b", "a")), ("f", 1, ("a", "c"))]
    df = records(spark, rows).unionByName(spark.createDataFrame([("a", 0, "[1]"), ("g", 1, None)], "snapshot_id string, record_number long, payload string"))
    got = sorted(map(tuple, profile.column_order(df).collect()), key=str)
    assert got == brute(rows)


def test_no_task_sorts_a_row_per_key(spark):
    """The minimum per column is hashed: a sorted aggregate holds a row per key of every record."""
    df = records(spark, [("a", i, "xyz") for i in range(20)])
    plan = profile.column_order(df)._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" not in plan and plan.count("HashAggregate") == 2

from loomwork.operators.hierarchy import descendant_counts, descendant_pairs, resolve_hierarchy


def brute(parent):
    out = {}
    for x in parent:
        path, pos, cur = [], {}, x
        while True:
            if cur in pos:
                out[x] = (min(path[pos[cur] :]), pos[cur], int(pos[cur] == 0))
                break
            pos[cur] = len(path)
            path.append(cur)
            nxt = parent.get(cur)
            if nxt is None or nxt not in parent:
                out[x] = (cur, len(path) - 1, 0)
                break
            cur = nxt
    return out


CASES = {1: None, 2: 1, 3: 2, 4: 99, 5: 6, 6: 5, 7: 7, 8: 5, 9: 8, 10: 1}
CASES |= {100 + i: 99 + i if i else None for i in range(300)}  # a deep chain
CASES |= {1000 + i: 1000 + (i + 1) % 12 for i in range(12)} | {1100: 1003, 1101: 1100}  # a circle of twelve with a tail


def test_all_shapes_of_links(spark):
    rows = [(k, v, "x") for k, v in CASES.items()] + [(3, 2, "y"), (None, 1, "z")]
    df = spark.createDataFrame(rows, "id bigint, parent bigint, root string")  # a further column with a clashing name
    got = resolve_hierarchy(df, with_path=True).cache()
    res = {r.id: (r.root, r.depth, r.on_cycle) for r in got.collect()}
    assert res == brute(CASES)
    assert got.count() == len(CASES)
    paths = {r.id: r.path for r in got.collect()}
    assert paths[3] == [1, 2, 3] and paths[399] == list(range(100, 400)) and paths[9] == [5, 8, 9] and paths[7] == [7]
    pairs = {(r.ancestor, r.descendant, r.distance) for r in descendant_pairs(got).filter("ancestor < 50").collect()}
    assert pairs == {(1, 2, 1), (1, 3, 2), (2, 3, 1), (1, 10, 1), (5, 8, 1), (5, 9, 2), (8, 9, 1)}
    counts = {r.id: (r.n_descendants, r.height) for r in descendant_counts(got).collect()}
    assert counts[1] == (3, 2) and counts[100] == (299, 299) and counts[4] == (0, 0)


def test_text_ids_hot_parent_and_empty(spark):
    rows = [("a", None)] + [(f"c{i}", "a") for i in range(300)]
    got = resolve_hierarchy(spark.createDataFrame(rows, "id string, parent string"))
    assert got.filter("root = 'a'").count() == 301 and got.filter("depth = 1").count() == 300
    assert resolve_hierarchy(spark.createDataFrame([], "id bigint, parent bigint")).count() == 0

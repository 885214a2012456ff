import hashlib
import zlib

import pytest

from quarry.llm import merkle as m


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(nodes):
    """Root and, per leaf, (sibling or None, place is odd) of every level."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, at in zip(paths, places, strict=True):
            path.append((nodes[at ^ 1] if at ^ 1 < len(nodes) else None, at & 1))
        nodes, places = [h(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)], [at >> 1 for at in places]
    return nodes[0], paths


def brute_leaf(r):
    return h(*["-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in ("doc_id", "source", "lang", "n_chars", "text")])


def brute(rows):
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    if not langs:
        return []
    trees = []
    for lang in langs:
        mine = sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, brute_leaf(r)))
        trees.append((mine, *brute_tree([brute_leaf(r) for r in mine])))
    root, tops = brute_tree([t[1] for t in trees])
    out = []
    for (mine, subroot, paths), top in zip(trees, tops, strict=True):
        for r, path in zip(mine, paths, strict=True):
            seen = dict(r)
            if r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0:
                seen["n_chars"] += 1
            got = brute_leaf(seen)
            for sibling, odd in path + top:
                got = h(got) if sibling is None else h(sibling, got) if odd else h(got, sibling)
            out.append((r["doc_id"], brute_leaf(r), subroot, root, h(*[s for s, _ in path + top if s]), got, got == root))
    return out


def as_text(rows):
    return sorted(map(str, map(tuple, rows)))


@pytest.mark.parametrize(("bits", "fan"), [(12, 4), (2, 1), (1, 2), (0, 2), (3, 3)])
def test_proofs_as_by_hand(spark, make_docs, bits, fan):
    """One tree holds most leaves; blocks and groups end at every place."""
    docs = make_docs([(i * 3 % 101, f"text {i}") for i in range(83)])
    docs = docs.selectExpr("doc_id", "text", "CASE WHEN doc_id < 7 THEN lang WHEN doc_id = 50 THEN 'é' WHEN doc_id < 20 THEN 'zz' ELSE 'en' END AS lang",
                           "source", "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE n_chars END AS n_chars")
    want = brute([r.asDict() for r in docs.collect()])
    assert as_text(m.manifest(m.with_leaves(docs), bits=bits, fan_bits=fan).collect()) == as_text(want)


@pytest.mark.parametrize("leaves", [1, 2, 3, 4, 5, 8, 9, 16, 17, 31, 33])
def test_every_size_of_one_tree(spark, make_docs, leaves):
    docs = make_docs([(i, "x") for i in range(leaves)]).selectExpr("doc_id", "text", "'en' AS lang", "source", "n_chars")
    want = brute([r.asDict() for r in docs.collect()])
    assert as_text(m.manifest(m.with_leaves(docs), bits=1, fan_bits=2).collect()) == as_text(want)


def test_defined_cases(spark, make_docs, edge_rows):
    docs = make_docs(edge_rows, extra=True)
    clash = docs.selectExpr("*", "'c' AS tree", "'c' AS digest", "1 AS at", "1 AS block", "'c' AS leaf", "'c' AS claimed", "'c' AS root")
    assert as_text(m.manifest(m.with_leaves(clash)).collect()) == as_text(brute([r.asDict() for r in docs.collect()]))
    assert m.manifest(m.with_leaves(make_docs([]))).count() == 0


def test_kept_proofs_fold_to_the_root(spark, make_docs):
    docs = make_docs([(i, f"t{i}") for i in range(40)])
    for r in m.manifest(m.with_leaves(docs), bits=2, fan_bits=1, keep_proofs=True).collect():
        trees = docs.select("lang").distinct().count()
        low = r["proof"][:len(r["proof"]) - m.levels_of(trees)]
        assert m.fold(r["leaf"], r["at"], low) == r["subroot"]
        assert h(*[s for s in r["proof"] if s]) == r["proof_sha256"]


def test_block_receives_a_bounded_number_of_roots(spark, make_docs):
    """Every block gets one root from each subtree of its group, however uneven the last one is."""
    placed = m.place(spark.range(37).selectExpr("'t' AS tree", "id", "sha2(string(id), 256) AS digest"), ["id"], 0)
    want, paths = brute_tree([h(str(i)) for i in range(37)])
    got = m.butterfly(placed, 0, 2).collect()
    assert len(got) == 37 and {r["root"] for r in got} == {want}
    assert all(list(r["upper"]) == [s for s, _ in paths[r["block"]]] for r in got)

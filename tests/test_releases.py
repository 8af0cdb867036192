"""Release trees: hashes by hand, depth, and what verification finds."""

import hashlib

from pyspark.sql import functions as F

from lodestone.operators import releases

H = lambda s: hashlib.sha256(s.encode()).hexdigest()
SCHEMA = "release string, section string, id string, digest string"


def by_hand(rows, leaf):
    """The root's hash and depth of (section, id, digest) rows, as nested plain recursion."""
    say = lambda v: "-" if v is None else f"={v}"
    lines = sorted({(H(f"{say(s)}\x1f{say(i)}"), f"{say(s)}\x1f{say(i)}\x1f{say(d)}") for s, i, d in rows})
    depth = next(d for d in range(16) if len(lines) <= leaf * 16**d)

    def node(prefix):
        own = [x for x in lines if x[0].startswith(prefix)]
        if len(prefix) == depth:
            return H("\x1e".join(line for _, line in own))
        return H("\x1e".join(f"{prefix}{c}\x1f{node(prefix + c)}" for c in "0123456789abcdef" if any(x[0].startswith(prefix + c) for x in own)))

    return node(""), depth


def rows_of(n, release="r"):
    return [(release, f"s{i % 3}", f"id{i}", f"d{i}") for i in range(n)]


def test_roots_by_hand(spark):
    rows = rows_of(300, "big") + rows_of(40, "middle") + rows_of(3, "small") + [(None, "s", "x", None), (None, "s", None, ""), (None, "s", "x", None)]
    rules = [("big", releases.RULES, f"p{i}", None if i == 3 else f"h{i}") for i in range(30)]
    nodes = releases.tree(spark.createDataFrame(rows + rules, SCHEMA).repartition(4), 4)
    got = {r.release: r for r in releases.frozen(nodes).collect()}
    depth = {(r.release, r.tree): r.depth for r in nodes.where("prefix = ''").collect()}
    for name in ("big", "middle", "small", None):
        want, d = by_hand([r[1:] for r in rows if r[0] == name], 4)
        assert (got[name].members_sha256, depth[name, "members"]) == (want, d)
        ruled = by_hand([r[1:] for r in rules], 4)[0] if name == "big" else H("")
        assert got[name].rules_sha256 == ruled and got[name].content_sha256 == H(f"{want}\x1e{ruled}")
    assert (got["big"].members, got["big"].rule_files, got[None].members, depth["big", "members"], depth["small", "members"]) == (300, 30, 2, 2, 0)
    assert releases.frozen(releases.tree(spark.createDataFrame([], SCHEMA))).count() == 0


def test_leaves_hold_few_members_however_many_there_are(spark):
    rows = spark.range(50_000).select(F.lit("r").alias("release"), F.lit("s").alias("section"), F.col("id"), F.lit("d").alias("digest"))
    nodes = releases.tree(rows, 100)
    leaves = nodes.where("length(prefix) = depth")
    assert leaves.agg(F.max("n")).first()[0] < 100 and leaves.agg(F.sum("n")).first()[0] == 50_000
    assert nodes.where("length(prefix) < depth").groupBy("prefix").count().agg(F.max("count")).first()[0] == 1


def test_differences_are_found_from_the_root_down(spark):
    rows = rows_of(500)
    changed = [(r, s, i, d + "x" if i in ("id7", "id400") else d) for r, s, i, d in rows]
    a, b = (releases.tree(spark.createDataFrame(x, SCHEMA), 4) for x in (rows, changed))
    want = {H(f"=s{int(i[2:]) % 3}\x1f={i}")[:2] for i in ("id7", "id400")}
    assert {r.prefix for r in releases.differing(a, b).collect()} == want
    assert releases.differing(a, a).count() == 0


def test_integrity_names_missing_members_then_rules_else_content(spark):
    every = [(name, s, f"{name}-{i}", "d") for name in ("same", "lost", "edited", "ruled", "both") for s, i in (("s", 1), ("s", 2), (releases.RULES, 3))]
    listed = spark.createDataFrame(every, SCHEMA)
    now = [(s, i, "e" if i in ("edited-2", "ruled-3", "both-3") else "d") for _, s, i, _ in every if i not in ("lost-1", "both-1")] + [("s", "unlisted", "d")]
    found = releases.integrity(releases.tree(listed), listed, spark.createDataFrame(now, "section string, id string, digest string"))
    assert sorted((r.subject, r.message) for r in found.collect()) == [("both", "rule_hash_differs"), ("both-1", "missing_member"), ("edited", "content_hash_differs"), ("lost", "content_hash_differs"), ("lost-1", "missing_member"), ("ruled", "rule_hash_differs")]
    gone = [x for x in now if x[1] != "ruled-3"]
    assert ("ruled", "rule_hash_differs") in {(r.subject, r.message) for r in releases.integrity(releases.tree(listed), listed, spark.createDataFrame(gone, "section string, id string, digest string")).collect()}

"""Joins that link requests to what is in force, codes to categories, and copies to originals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.graph import Growing, Scratch, strong_components
from lodestone.operators.history import in_force


def select_config(requests: DataFrame, candidates: DataFrame, assertions: DataFrame) -> DataFrame:
    """(request, n_in_force, config, outcome): a request's candidates with a link in force on its day.

    requests (request, day), candidates (request, config), assertions (config, valid_from, valid_to).
    """
    live = in_force(candidates.join(requests, "request"), assertions, "config", "day")
    found = live.groupBy("request").agg(F.count_distinct("config").alias("n"), F.min("config").alias("only"))
    n = F.coalesce("n", F.lit(0))
    outcome = F.when(n == 0, "no_uses_edition").when(n == 1, "selected").otherwise("multiple_candidates")
    return requests.join(found, "request", "left").select("request", n.cast("bigint").alias("n_in_force"), F.when(n == 1, F.col("only")).alias("config"), outcome.alias("outcome"))


def codes_in_ranges(codes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Codes (code, letter, major) joined to the ranges (category, lo_letter, lo_major, hi_letter, hi_major) that hold them.

    A range is cut into one row per letter and major, so the join is an equality.
    """
    letters = F.transform(F.sequence(F.ascii("lo_letter"), F.ascii("hi_letter")), lambda c: F.char(c))
    rows = ranges.where((F.col("lo_letter") < F.col("hi_letter")) | ((F.col("lo_letter") == F.col("hi_letter")) & (F.col("lo_major") <= F.col("hi_major"))))
    rows = rows.withColumn("letter", F.explode(letters))
    lo, hi = F.when(F.col("letter") == F.col("lo_letter"), F.col("lo_major")).otherwise(0), F.when(F.col("letter") == F.col("hi_letter"), F.col("hi_major")).otherwise(99)
    rows = rows.select("category", "letter", F.explode(F.sequence(lo.cast("int"), hi.cast("int"))).alias("major"), (F.col("minor") if "minor" in ranges.columns else F.lit(None).cast("string")).alias("_minor"))
    # a code meets the ranges of its letter and major; a range with a minor holds the minors that begin so
    return codes.join(rows, ["letter", "major"]).where("_minor IS NULL OR startswith(coalesce(minor, ''), _minor)" if "minor" in codes.columns else "_minor IS NULL").drop("_minor")


def answers(codes: DataFrame, asked: DataFrame, claims: DataFrame, ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What `membership` says, without a row for every pair: (category, base), the answer for codes that no range below
    the category holds, and (category, code, answer) of the codes that some range holds.

    A category is answered once, from the ends of the claims back, and all that lead to it use that
    answer.  Where categories lead back to themselves, and only among those, a category is answered along each simple path
    inside the circle, as an answer there depends on where it was asked from.
    """
    scratch = Scratch(claims.sparkSession)
    sets = ranges.select("target").distinct()
    told = claims.select(F.col("category").alias("node"), "role", "target", "accepted")
    known = told.select(F.col("node").alias("target")).distinct()
    told = told.join(sets.withColumn("_set", F.lit(True)), "target", "left").join(known.withColumn("_cat", F.lit(True)), "target", "left")
    leaf = F.coalesce("_set", F.lit(False))
    told = scratch.keep(told.select("node", "role", "target", F.coalesce("accepted", F.lit(False)).alias("accepted"), leaf.alias("leaf"), (~leaf & F.coalesce("_cat", F.lit(False))).alias("inner")))
    hits = scratch.keep(codes_in_ranges(codes, ranges.withColumnRenamed("target", "category")).select("code", F.col("category").alias("target")).distinct())
    # a unit is a category where it is asked: alone, or after others of its circle
    every = asked.select(F.col("category").alias("node")).union(told.select("node")).where("node IS NOT NULL").distinct()
    units = scratch.keep(every.select(F.array("node").alias("unit"), "node", F.lit(0).alias("loops_in"), F.lit(0).alias("loops_ex")))
    inner = told.where("accepted AND inner").select("node", "role", "target")
    ways = scratch.keep(inner.select(F.array("node").alias("unit"), "role", F.array("target").alias("below")))
    kind = units.schema["node"].dataType.simpleString()
    cells = ("n_in", "in_true", "ex_true", "in_unknown", "ex_unknown")
    base = Growing(scratch, f"unit array<{kind}>, {', '.join(f'{c} long' for c in cells)}, base string")
    some = Growing(scratch, f"unit array<{kind}>, code {hits.schema['code'].dataType.simpleString()}, answer string")
    fixed = scratch.keep(told.groupBy("node").agg(F.count_if(F.col("role") == "include").alias("n_in"), *[F.count_if((F.col("role") == r) & (~F.col("accepted") | ~(F.col("leaf") | F.col("inner")))).alias(f"open_{r[:2]}") for r in ("include", "exclude")]))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    value = lambda d: F.when(F.col("n_in") == 0, "unknown").when(F.col("ex_true") + d("ex_true") > 0, "false").when(F.col("in_unknown") + F.col("ex_unknown") + d("in_unknown") + d("ex_unknown") > 0, "unknown").when(F.col("in_true") + d("in_true") > 0, "true").otherwise("false")
    left, parted = units.count(), False
    while left:
        done = base.rows().select(F.col("unit").alias("below"), F.col("base").alias("b"))
        todo = units.join(base.rows().select("unit"), "unit", "left_anti")
        waiting = ways.join(done, "below", "left_anti").select("unit").distinct()
        mine = ways.join(done, "below")
        count = lambda who, v: F.count_if((F.col("role") == who) & (F.col("b") == v))
        sums = mine.groupBy("unit").agg(*[count(r, v).alias(f"{r[:2]}_{v}") for r in ("include", "exclude") for v in ("true", "unknown")])
        ready = todo.join(waiting, "unit", "left_anti").join(fixed, "node", "left").join(sums, "unit", "left")
        ready = ready.select("unit", zero("n_in").alias("n_in"), zero("in_true").alias("in_true"), zero("ex_true").alias("ex_true"), (zero("in_unknown") + zero("open_in") + F.col("loops_in")).alias("in_unknown"), (zero("ex_unknown") + zero("open_ex") + F.col("loops_ex")).alias("ex_unknown"))
        whole = base.add(ready.withColumn("base", value(lambda c: F.lit(0))))
        n = whole.count()
        left -= n
        if not n:
            if parted:
                raise ValueError("circles remain")
            units, ways, parted = *_circles(scratch, todo, inner, ways), True
            left = units.count()
            continue
        # what the codes known below change in those sums: a claim's answer for the code instead of its base
        own = whole.select("unit", F.element_at("unit", -1).alias("node")).join(told.where("accepted AND leaf"), "node").join(hits, "target").select("unit", "code", "role", F.lit("true").alias("v"), F.lit("false").alias("b"))
        below = mine.join(whole.select("unit"), "unit", "left_semi").join(some.rows().withColumnsRenamed({"unit": "below", "answer": "v"}), "below").select("unit", "code", "role", "v", "b")
        step = lambda r, v: F.count_if((F.col("role") == r) & (F.col("v") == v)) - F.count_if((F.col("role") == r) & (F.col("b") == v))
        delta = own.unionAll(below).groupBy("unit", "code").agg(*[step(r, v).alias(f"d_{r[:2]}_{v}") for r in ("include", "exclude") for v in ("true", "unknown")])
        each = delta.join(whole, "unit")
        some.add(each.select("unit", "code", value(lambda c: F.col(f"d_{c}")).alias("answer"), "base").where("answer <> base").drop("base"))
    base_rows = base.rows().select("unit", "base")
    wanted = asked.select(F.col("category")).where("category IS NOT NULL").distinct()
    of = lambda rows: rows.where(F.size("unit") == 1).withColumn("category", F.get("unit", F.lit(0))).drop("unit").join(wanted, "category", "left_semi")
    return of(base_rows).select("category", "base"), of(some.rows()).select("category", "code", "answer")


def _circles(scratch: Scratch, todo: DataFrame, inner: DataFrame, ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units and ways with every circle among those to be answered unfolded into its simple paths."""
    open_ = todo.select("node")
    rest = inner.join(open_, "node", "left_semi").join(open_.withColumnRenamed("node", "target"), "target", "left_semi")
    comps = strong_components(rest.select(F.col("node").alias("src"), F.col("target").alias("dst")))
    at = comps.select("node", "component").join(inner, "node").join(comps.select(F.col("node").alias("target"), F.col("component").alias("_c")), "target", "left")
    inside = scratch.keep(at.select("node", "role", "target", F.coalesce(F.col("component") == F.col("_c"), F.lit(False)).alias("same")))
    kind = todo.schema["node"].dataType.simpleString()
    paths = Growing(scratch, f"unit array<{kind}>, node {kind}")
    new = paths.add(todo.join(comps, "node", "left_semi").select("unit", "node"))
    while not new.isEmpty():
        go = new.join(inside.where("same"), "node").where(~F.array_contains("unit", F.col("target")))
        new = paths.add(go.select(F.array_append("unit", F.col("target")).alias("unit"), F.col("target").alias("node")).distinct())
    on = paths.rows().join(inside, "node")
    back = F.col("same") & F.array_contains("unit", F.col("target"))
    loops = on.where(back).groupBy("unit").agg(F.count_if(F.col("role") == "include").alias("loops_in"), F.count_if(F.col("role") == "exclude").alias("loops_ex"))
    there = paths.rows().join(loops, "unit", "left").select("unit", "node", F.coalesce("loops_in", F.lit(0)).cast("int").alias("loops_in"), F.coalesce("loops_ex", F.lit(0)).cast("int").alias("loops_ex"))
    units = scratch.keep(todo.join(comps, "node", "left_anti").select("unit", "node", "loops_in", "loops_ex").unionAll(there))
    lead = on.where(~back).select("unit", "role", F.when(F.col("same"), F.array_append("unit", F.col("target"))).otherwise(F.array("target")).alias("below"))
    plain = ways.join(comps.select(F.array("node").alias("unit")), "unit", "left_anti").select("unit", "role", "below")
    return units, scratch.keep(plain.unionAll(lead))


def membership(codes: DataFrame, asked: DataFrame, claims: DataFrame, ranges: DataFrame) -> DataFrame:
    """(code, category, answer): whether a category holds a code, as true, false or unknown, of every code and asked category.

    codes (code, letter, major, minor), asked (category), claims (category, role include or exclude,
    target, accepted), current and in force; a target is a code set of ranges (target, lo_letter,
    lo_major, hi_letter, hi_major, minor) or another category.  No inclusion is unknown; an accepted
    exclusion that holds the code is false; any claim that is not accepted, leads back to a category it was asked
    through or to nothing known, or is unknown itself, makes the answer unknown; else it is whether an
    inclusion holds the code.
    """
    base, some = answers(codes, asked, claims, ranges)
    every = codes.select("code").distinct().join(base)  # the answers asked for
    return every.join(some, ["category", "code"], "left").select("code", "category", F.coalesce("answer", "base").alias("answer"))


def first_reason(*conditions: tuple[str, Column]) -> Column:
    """The first reason, in the order given, whose condition holds; `linked` if none does."""
    return reduce(lambda acc, c: acc.when(F.coalesce(c[1], F.lit(False)), c[0]), conditions[1:], F.when(F.coalesce(conditions[0][1], F.lit(False)), conditions[0][0])).otherwise("linked")


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Rows whose non-null reference has no row."""
    return child.where(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def release_changes(old: DataFrame, new: DataFrame, key: str, version: str, reasons: DataFrame | None = None) -> DataFrame:
    """(key, change, before, after, reason): versions that a release added, corrected or removed; reasons (version, reason) are those of corrections."""
    a, b = old.select(key, F.col(version).alias("before")), new.select(key, F.col(version).alias("after"))
    what = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "corrected")
    both = a.join(b, key, "full_outer").withColumn("change", what).where("change IS NOT NULL")
    if reasons is not None:
        both = both.join(reasons.select(F.col(version).alias("after"), F.col("reason").alias("_r")), "after", "left").withColumn("reason", F.when(F.col("change") == "corrected", F.col("_r")))
    return both.select(key, "change", "before", "after", *(["reason"] if reasons is not None else []))


def diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): added, removed or corrected rows of two snapshots."""
    a, b = old.select(F.col(key), F.col(digest).alias("_a")), new.select(F.col(key), F.col(digest).alias("_b"))
    what = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "corrected")
    return a.join(b, key, "full_outer").select(key, what.alias("change")).where("change is not null")


def verify_copy(expected: DataFrame, actual: DataFrame, key: str, digest: str, addressed: str = "objects/sha256/") -> DataFrame:
    """(key, status): byte_identical, missing, hash_mismatch or extra; a key below `addressed` must end in the hash of its content."""
    a, b, named = expected.select(F.col(key), F.col(digest).alias("_a")), actual.select(F.col(key), F.col(digest).alias("_b")), F.col(key).cast("string")
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when((F.col("_a") == F.col("_b")) & (~named.startswith(addressed) | (F.substring_index(named, "/", -1) == F.col("_b"))), "byte_identical").otherwise("hash_mismatch")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def notices_for(requests: DataFrame, notices: DataFrame) -> DataFrame:
    """Requests with their open notices, over notices (notice, affects ARRAY, open); allowed when there is none."""
    hits = notices.where("open").select("notice", F.explode("affects").alias("coverage"))
    found = requests.join(hits, "coverage").groupBy("request").agg(F.array_sort(F.collect_set("notice")).alias("notices"))
    return requests.join(found, "request", "left").withColumn("allowed", F.col("notices").isNull())


def freeze(rows: DataFrame, release: str, member: str, digest: Column, digits: int = 2) -> DataFrame:
    """(release, members, content_sha256): a hash over the sorted (id, row hash) of a release's members.

    Members are dealt to buckets by the first hex digits of the hash of their id; a bucket's hash is that
    of its sorted members, the release's that of its sorted buckets.  More digits keep buckets small.
    """
    text = F.coalesce(F.col(member).cast("string"), F.lit(""))
    each = rows.select(release, F.concat_ws("\u001f", text, digest).alias("_d"), F.substring(F.sha2(text, 256), 1, digits).alias("_b"))
    part = each.groupBy(release, "_b").agg(F.count("*").alias("_n"), F.sha2(F.array_join(F.array_sort(F.collect_list("_d")), "\u001e"), 256).alias("_h"))
    return part.groupBy(release).agg(F.sum("_n").alias("members"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_h"))), lambda x: F.concat(x["_b"], x["_h"])), "\u001e"), 256).alias("content_sha256"))


def scope_relation(pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """(a, b, relation) of pairs of categories, from the answers (code, category, answer) over all codes.

    Any unknown answer, or no code at all, makes a pair not comparable; two empty scopes are the same.
    """
    side = lambda name, out: answers.select(F.col("category").alias(name), "code", F.col("answer").alias(out))
    x, y = F.col("_x") == "true", F.col("_y") == "true"
    seen = pairs.join(side("a", "_x"), "a").join(side("b", "_y"), ["b", "code"]).groupBy("a", "b")
    seen = seen.agg(F.bool_or((F.col("_x") == "unknown") | (F.col("_y") == "unknown")).alias("_unknown"), F.count_if(x & y).alias("_both"), F.count_if(x & ~y).alias("_a"), F.count_if(y & ~x).alias("_b"))
    none_a, none_b = F.col("_a") == 0, F.col("_b") == 0
    relation = F.when(F.coalesce("_unknown", F.lit(True)), "not_comparable").when(none_a & none_b, "same_scope").when(none_a, "narrower").when(none_b, "broader").when(F.col("_both") > 0, "overlaps").otherwise("disjoint")
    return pairs.join(seen, ["a", "b"], "left").select("a", "b", relation.alias("relation"))


def scope_relations(pairs: DataFrame, codes: DataFrame, base: DataFrame, some: DataFrame) -> DataFrame:
    """(a, b, relation) as `scope_relation` gives it, from the answers in the form of `answers`: a pair meets only the codes that a range below one of its two holds, the rest are counted."""
    side = lambda c, out: pairs.join(some.select(F.col("category").alias(c), "code", F.col("answer").alias(out)), c)
    none = F.lit(None).cast("string")
    met = side("a", "_x").select("a", "b", "code", "_x", none.alias("_y")).union(side("b", "_y").select("a", "b", "code", none, "_y"))
    met = met.groupBy("a", "b", "code").agg(F.max("_x").alias("_x"), F.max("_y").alias("_y"))
    of = lambda c: base.select(F.col("category").alias(c), F.col("base").alias(f"_base_{c}"))
    known = pairs.distinct().join(of("a"), "a", "left").join(of("b"), "b", "left")
    met = met.join(known, ["a", "b"]).withColumn("_x", F.coalesce("_x", "_base_a")).withColumn("_y", F.coalesce("_y", "_base_b"))
    says = {"_unknown": lambda x, y: (x == "unknown") | (y == "unknown"), "_both": lambda x, y: (x == "true") & (y == "true"), "_a": lambda x, y: (x == "true") & (y != "true"), "_b": lambda x, y: (y == "true") & (x != "true")}
    seen = met.groupBy("a", "b").agg(F.count("*").alias("_met"), *[F.count_if(f(F.col("_x"), F.col("_y"))).alias(n) for n, f in says.items()])
    whole = known.join(seen, ["a", "b"], "left").join(F.broadcast(codes.agg(F.count_distinct("code").alias("_codes"))))  # one row
    rest = F.col("_codes") - F.coalesce("_met", F.lit(0))
    whole = whole.withColumns({n: F.coalesce(n, F.lit(0)) + F.when(F.coalesce(f(F.col("_base_a"), F.col("_base_b")), F.lit(False)), rest).otherwise(0) for n, f in says.items()})
    open_ = (F.col("_codes") == 0) | F.col("_base_a").isNull() | F.col("_base_b").isNull() | (F.col("_unknown") > 0)
    relation = F.when(open_, "not_comparable").when((F.col("_a") == 0) & (F.col("_b") == 0), "same_scope").when(F.col("_a") == 0, "narrower").when(F.col("_b") == 0, "broader").when(F.col("_both") > 0, "overlaps").otherwise("disjoint")
    return pairs.join(whole.select("a", "b", relation.alias("relation")), ["a", "b"]).select("a", "b", "relation")


def status_counts(report: DataFrame, status: str = "status") -> DataFrame:
    return report.groupBy(status).agg(F.count("*").alias("n"))

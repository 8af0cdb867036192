"""URL verdicts: host and path rules, and boosted trees on lexical features, all in DataFrame functions.

The trees are fitted on URLs whose label is known by histogram boosting: features are binned at
quantiles, and each level of a tree takes one aggregate of gradients by (leaf, feature, bin) over the
labelled rows; only those sums, of bounded size, reach the driver.  Beside lexical features they read how
often URLs of the same host suffix or first path segment were labelled 1.  A fitted model is a Column
expression, so judging a URL stays inside the JVM.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (rule, verdict): host, then path from the first slash on.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """STRUCT<rule, verdict> of the longest rule that fits, or null.  Rules are a list given by the caller."""
    out = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def stems(host: Column, path: Column) -> dict[str, Column]:
    """What label statistics are kept of: the last label of a host, its last two, its last three, and the first segment of the path."""
    return {"suffix_1": F.substring_index(host, ".", -1), "suffix_2": F.substring_index(host, ".", -2), "suffix_3": F.substring_index(host, ".", -3), "segment": F.split_part(path, F.lit("/"), F.lit(2))}


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters in bits; 0 for an empty text."""
    letters = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    share = F.transform(letters, lambda c: (F.length(text) - F.length(F.replace(text, c))) / F.length(text))
    return F.coalesce(F.aggregate(share, F.lit(0.0), lambda acc, x: acc - x * F.log2(x)), F.lit(0.0))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical features of a URL; a null URL counts as empty."""
    url = F.coalesce(url, F.lit(""))
    n = F.length(url)
    query = F.regexp_extract(url, r"(?s)\A[^?#]*\?([^#]*)", 1)
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    share = lambda text, of: F.length(text) / F.greatest(F.length(of), F.lit(1))
    return {
        "length": n.cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": count(path, "/[^/]"),
        "labels": count(host, r"\."),
        "digits": share(F.regexp_replace(url, r"[^0-9]", ""), url),
        "hyphens": count(host, "-"),
        "entropy": entropy(host),
        "params": F.when(query == "", 0.0).otherwise(1.0 + count(query, "&")),
        "fragment": count(url, "#"),
        "https": F.startswith(url, F.lit("https:")).cast("double"),
        "path_entropy": entropy(path),
        "path_digits": share(F.regexp_replace(path, r"[^0-9]", ""), path),
    }


@dataclass
class Trees:
    """Boosted trees over binned features: names, bin edges, label rates by stem as tables (key, rate), and (feature, bin, left, right) trees."""

    names: list[str]
    edges: dict[str, list[float]]
    rates: dict[str, DataFrame]
    prior: float
    trees: list = field(default_factory=list)

    def bins(self, prefix: str = "") -> dict[str, Column]:
        """The bin of every feature, read from columns of these names: how many of its edges lie below it."""
        return {k: F.expr(f"cast(0 {''.join(f' + if(`{prefix}{k}` > {e!r}D, 1, 0)' for e in self.edges[k])} as int)") for k in self.names}

    def score(self, prefix: str = "") -> Column:
        """The sum of the trees over columns of bins, as one expression for the compiler."""

        def walk(t):
            return f"{float(t)!r}D" if not isinstance(t, tuple) else f"if(`{prefix}{t[0]}` <= {t[1]}, {walk(t[2])}, {walk(t[3])})"

        return F.expr(" + ".join([f"{self.prior!r}D", *map(walk, self.trees)]))


def with_rates(rows: DataFrame, rates: dict[str, DataFrame], unseen: float) -> DataFrame:
    """rows (host, path, ..) with the label rate of each stem; a stem that was never seen has the rate of all."""
    for name, key in stems(F.col("host"), F.col("path")).items():
        # at most as many keys as the fit had rows, which is bounded by its sample
        table = F.broadcast(rates[name].select(F.col("key").alias("__key"), F.col("rate").alias(name)))
        rows = rows.join(table, key == F.col("__key"), "left").drop("__key").withColumn(name, F.coalesce(name, F.lit(unseen)))
    return rows


def encoded(rows: DataFrame, prior: float, folds: int = 5) -> DataFrame:
    """Labelled rows (url, label, host, path) with their lexical features and, of each stem, the label rate among the rows of other folds.

    A rate of a row's own label would tell it; a stem of one row only has the rate of all.  The rows are
    bounded by the sample, so the sums over a stem may meet in one task.
    """
    rows = rows.withColumn("__fold", F.pmod(F.xxhash64("url"), F.lit(folds)))
    known = stems(F.col("host"), F.col("path"))
    for name, key in known.items():
        every, own = Window.partitionBy(key), Window.partitionBy(key, "__fold")
        hits, n = (F.sum(x).over(every) - F.sum(x).over(own) for x in (F.col("label"), F.lit(1)))
        rows = rows.withColumn(name, (hits + 2.0 * prior) / (n + 2.0))
    return rows.select("label", *[v.alias(k) for k, v in lexical(F.col("url"), F.col("host"), F.col("path")).items()], *known)


def fit(labelled: DataFrame, rounds: int = 8, depth: int = 3, n_bins: int = 32, rate: float = 0.5, sample: int = 20_000) -> Trees:
    """Boosted trees from (url, label 0/1).

    At most `sample` rows, first by the hash of their URL, are used; being so bounded they are one
    partition, which the aggregates of every level read without a shuffle.  Label rates are kept of every
    stem that the rows have.  Null URLs and labels are left out.  Without rows of both labels the model
    is the prior.  Gains that tie go to the earlier feature and bin.
    """
    rows = labelled.where("url is not null and label is not null").orderBy(F.xxhash64("url"), "url", "label").limit(sample)
    rows = materialize(rows.select("url", F.col("label").cast("int").alias("label"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).coalesce(1))
    n, y = rows.agg(F.count("*"), F.sum("label")).first()
    p = (float(y or 0) + 0.5) / (n + 1.0)
    prior = math.log(p / (1 - p))
    rates = {}
    for name, key in stems(F.col("host"), F.col("path")).items():
        rates[name] = materialize(rows.groupBy(key.alias("key")).agg(((F.sum("label") + 2.0 * p) / (F.count("*") + 2.0)).alias("rate")).coalesce(1))
    names = [*lexical(F.col("url"), F.col("host"), F.col("path")), *rates]
    model = Trees(names, {}, rates, prior)
    if not n or not y or y == n:
        model.edges = {k: [] for k in names}
        return model
    rows = materialize(encoded(rows, p).coalesce(1))
    cuts = rows.agg(*[F.percentile_approx(k, [i / n_bins for i in range(1, n_bins)], 1000).alias(k) for k in names]).first()
    model.edges = {k: sorted(set(cuts[k])) for k in names}
    bins = model.bins()
    # equal binned rows are one row with a weight
    rows = rows.select("label", F.array(*[bins[k] for k in names]).alias("bins")).groupBy("label", "bins").agg(F.count("*").cast("double").alias("n"))
    rows = materialize(rows.withColumn("margin", F.lit(prior)).coalesce(1))
    for _ in range(rounds):
        q = 1.0 / (1.0 + F.exp(-F.col("margin")))
        splits: dict[int, tuple] = {}  # node: feature, bin, value left and right of it
        for level in range(depth):
            # the splits are array literals, so all levels share one compiled plan
            g = rows.select(_node(splits, names, depth).alias("node"), (F.col("n") * (q - F.col("label"))).alias("g"), (F.col("n") * q * (1 - q)).alias("h"), F.posexplode("bins").alias("f", "b"))
            sums: dict[tuple, dict] = {}
            for r in g.groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                if r.node >= 2**level:
                    sums.setdefault((r.node, r.f), {})[r.b] = (r.g, r.h)
            found = {node: _best_split(node, sums, names) for node in sorted({k for k, _ in sums})}
            splits |= {k: v for k, v in found.items() if v}
        if 1 not in splits:
            break

        def tree(at: int, own: float):
            if at not in splits:
                return rate * own
            k, b, left, right = splits[at]
            return (k, b, tree(2 * at, left), tree(2 * at + 1, right))

        model.trees.append(tree(1, 0.0))
        leaf = ["0D"] * 2 ** (depth + 1)
        for at, (_, _, left, right) in splits.items():
            leaf[2 * at], leaf[2 * at + 1] = f"{rate * left!r}D", f"{rate * right!r}D"
        gain = F.element_at(F.expr(f"array({', '.join(leaf)})"), (_node(splits, names, depth) + 1).cast("int"))
        rows = materialize(rows.withColumn("margin", F.col("margin") + gain))
    return model


def _node(splits: dict[int, tuple], names: list[str], depth: int) -> Column:
    """The node that a row of bins comes to: node k leads to 2k up to the bin of its split and to 2k + 1 beyond."""
    of = ", ".join(str(names.index(splits[k][0]) + 1 if k in splits else 0) for k in range(1, 2**depth))
    at = ", ".join(str(splits[k][1] if k in splits else 0) for k in range(1, 2**depth))
    last = 2**depth - 1
    feature = f"if(k > {last}, 0, element_at(array({of}), least(k, {last})))"
    return F.expr(f"aggregate(sequence(1, {depth}), 1, (k, level) -> if({feature} = 0, k, if(element_at(bins, greatest({feature}, 1)) <= element_at(array({at}), least(k, {last})), 2 * k, 2 * k + 1)))")


def _best_split(node: int, sums: dict, names: list[str]):
    """(feature, bin, left value, right value) of the largest gain, ties to the earlier feature and bin."""
    best, gain = None, 1e-6
    for f, name in enumerate(names):
        each = sums.get((node, f), {})
        g, h = sum(x for x, _ in each.values()), sum(x for _, x in each.values())
        gl = hl = 0.0
        for b in sorted(each)[:-1]:
            gl, hl = gl + each[b][0], hl + each[b][1]
            value = gl * gl / (hl + 1.0) + (g - gl) ** 2 / (h - hl + 1.0) - g * g / (h + 1.0)
            if value > gain + 1e-9:
                best, gain = (name, b, -gl / (hl + 1.0), -(g - gl) / (h - hl + 1.0)), value
    return best


def scored(rows: DataFrame, model: Trees) -> DataFrame:
    """rows (url, host, path, ..) with block_score, the trees' probability of label 1."""
    kept = rows.columns
    known = with_rates(rows, model.rates, 1.0 / (1.0 + math.exp(-model.prior)))
    features = lexical(F.col("url"), F.col("host"), F.col("path")) | {k: F.col(k) for k in model.rates}
    named = known.select(*[F.col(k) for k in kept], *[v.alias(f"__{k}") for k, v in features.items()])
    binned = named.select(*[F.col(k) for k in kept], *[v.alias(f"__{k}") for k, v in model.bins("__").items()])
    score = 1.0 / (1.0 + F.exp(-model.score("__")))
    return binned.select(*kept, score.alias("block_score"))


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    return pages.withColumn("host", host(F.col(url))).withColumn("path", path(F.col(url)))


def quality(labelled: DataFrame, folds: int = 5, threshold: float = 0.5, **params) -> dict[str, float]:
    """precision, recall, share (of label 1) and n on the URLs whose hash is 0 modulo `folds`, by trees fitted on the others."""
    rows = labelled.select("url", "label").where("url is not null and label is not null")
    held = F.pmod(F.xxhash64("url"), F.lit(folds)) == 0
    model = fit(rows.where(~held), **params)
    yes, real = F.col("block_score") >= threshold, F.col("label") == 1
    r = scored(parsed(rows.where(held)), model).agg(F.count("*").alias("n"), F.count_if(yes & real).alias("hit"), F.count_if(yes).alias("yes"), F.count_if(real).alias("real")).first()
    return {"precision": r.hit / max(1, r.yes), "recall": r.hit / max(1, r.real), "share": r.real / max(1, r.n), "n": r.n}


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, threshold: float = 0.5, url: str = "url", page_id: str = "page_id", **params) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score: one row per page.

    The longest rule that fits decides; any other URL is judged by trees fitted on `labelled`
    (url, label 1 = block), by default the URLs of the table that a rule decides.  A null URL, or one
    without ://, has an empty host and path and is judged by the trees.  URLs are read whole, however
    long.  Repeated rows are judged alike; an empty table gives no rows; other columns of the table,
    whatever their names, are ignored.
    """
    rows = parsed(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")))
    ruled = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    if labelled is None:
        labelled = ruled.where("r is not null").select("url", F.when(F.col("r.verdict") == "block", 1).otherwise(0).alias("label"))
    done = scored(ruled, fit(labelled, **params))
    return done.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), F.when(F.col("block_score") >= threshold, "block").otherwise("allow")).alias("verdict"), "block_score")

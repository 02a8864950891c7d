"""URL filter: host and path rules first, else a logistic regression on hashed character n-grams.

All of it is DataFrame functions. The model is fitted by full-batch gradient descent inside one higher-order
expression over the labelled table, which is small by definition, and joins the scoring as a scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import unused

BUCKETS = 8192
#: (action, host, path): longest wins.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Words of the labelled URLs. Each stands once in a host and once in a path.
_BAD = "poker roulette jackpot slots blackjack lottery wager gambling porn escort nude webcams hentai viagra cialis steroids warez keygen cracked torrents phishing malware popunder replica".split()
_GOOD = "library science newspaper garden history school museum cooking weather forum travel orchestra recipes football hospital university nature energy chemistry poetry language railway mountains kitchen theatre finance gallery village research software teacher insurance architecture geology painting economics cycling parliament astronomy knitting hiking medicine physics biology grammar dictionary harbour bakery".split()
#: What they are combined with says nothing: both labels have all of it.
_SUBS, _STARTS, _ENDS, _TOPS = ("", "www.", "m.", "blog."), ("", "my", "top-", "big"), ("", "24", "-online", "s-portal"), ("com", "org", "net", "info")
_HOSTS, _PATHS = ("pages", "sites", "users", "home"), ("/en/12", "/index.html", "/fr/301/", "/view?page=2", "/", "")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """A small labelled table (url, bad): every word in two hosts with paths that say nothing, and in two paths on hosts that say nothing."""
    rows = []
    for words, bad in ((_BAD, 1), (_GOOD, 0)):
        for i, w in enumerate(words):
            for k in range(2):
                pick = lambda xs, step: xs[(i // step + k * (len(xs) // 2) + step) % len(xs)]  # noqa: B023, E731
                word = f"{pick(_STARTS, 1) if k else ''}{w}{pick(_ENDS, 2)}"
                rows.append((f"https://{pick(_SUBS, 1)}{word}.example.{pick(_TOPS, 2)}{pick(_PATHS, 1)}", bad))
                rows.append((f"http://{pick(_SUBS, 2)}{pick(_HOSTS, 1)}.example.{pick(_TOPS, 1)}/{pick(('posts', 'a', '2019/05', 'news'), 1)}/{word}{pick(('.html', '-1', '/'), 1)}", bad))
    return spark.createDataFrame(rows, "url string, bad int")


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def grams(host: Column, path: Column, n: int = 4, buckets: int = BUCKETS) -> Column:
    """The hashed character n-grams of host and path, each padded and marked by its part; repeats count."""

    def of(part: Column, mark: str) -> Column:
        chars = F.split(F.concat(F.lit(mark + "^"), part, F.lit("$")), "")
        gram = lambda cs, i: F.concat(F.lit(mark), *[F.coalesce(F.get(cs, i + k), F.lit("")) for k in range(n)])
        # a one-element array binds the characters, so that they are split once and a long url costs what it holds
        every = lambda cs: F.transform(F.sequence(F.lit(0), F.greatest(F.size(cs) - n, F.lit(0))), lambda i: F.pmod(F.xxhash64(gram(cs, i)), F.lit(buckets)).cast("int"))
        return F.element_at(F.transform(F.array(chars), every), 1)

    return F.concat(of(host, "h"), of(path, "p"))


def _margin(idx: Column, w: Column) -> Column:
    """Bias plus the summed weights of the n-grams over the root of their number; w has the bias at its end."""
    return F.element_at(w, -1) + F.aggregate(idx, F.lit(0.0), lambda a, i: a + F.element_at(w, i + 1)) / F.sqrt(F.greatest(F.size(idx), F.lit(1)))


def fit(labelled: DataFrame, buckets: int = BUCKETS, epochs: int = 120, rate: float = 15.0, decay: float = 1e-4) -> DataFrame:
    """One row with column w: the bucket weights, and the bias last. Rows without url or label are left out; without any rows, all weights are 0."""
    rows = labelled.where("url is not null and bad is not null").select(grams(host_of(F.col("url")), path_of(F.col("url")), buckets=buckets).alias("idx"), F.col("bad").cast("double").alias("y"))
    one = rows.agg(F.array_sort(F.collect_list(F.struct("y", "idx"))).alias("rows"))
    # for each bucket, the positions of rows that have it, as often as they have it
    flat = F.flatten(F.transform("rows", lambda r, p: F.transform(r["idx"], lambda i: F.struct(i.alias("b"), p.alias("p"), (F.lit(1.0) / F.sqrt(F.size(r["idx"]))).alias("s")))))
    one = one.select("rows", flat.alias("cells")).select("rows", F.explode_outer("cells").alias("c"))
    cells = one.groupBy("c.b").agg(F.collect_list(F.struct("c.p", "c.s")).alias("at"), F.first("rows").alias("rows"))
    cells = cells.agg(F.map_from_entries(F.filter(F.collect_list(F.struct("b", "at")), lambda e: e["b"].isNotNull())).alias("at"), F.first("rows").alias("rows"))
    cells = cells.select("rows", F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda i: F.coalesce(F.element_at("at", i), F.array().cast("array<struct<p:int,s:double>>"))).alias("at"))
    n = F.greatest(F.size("rows"), F.lit(1))

    def step(w: Column, _: Column) -> Column:
        # a one-element array binds the errors, so that they are computed once for the epoch
        errs = F.array(F.transform("rows", lambda r: r["y"] - F.lit(1.0) / (F.lit(1.0) + F.exp(-_margin(r["idx"], w)))))
        new = F.transform(errs, lambda e: F.concat(
            F.transform("at", lambda cell, b: F.element_at(w, b + 1) * (1 - decay) + rate / n * F.aggregate(cell, F.lit(0.0), lambda a, x: a + F.element_at(e, x["p"] + 1) * x["s"])),
            F.array(F.element_at(w, -1) + F.lit(0.5) / n * F.aggregate(e, F.lit(0.0), lambda a, x: a + x)),
        ))
        return F.element_at(new, 1)

    return cells.select(F.aggregate(F.sequence(F.lit(1), F.lit(epochs)), F.array_repeat(F.lit(0.0), buckets + 1), step).alias("w"))


def judge(urls: DataFrame, model: DataFrame, rules: list[tuple[str, str, str]] = RULES, buckets: int = BUCKETS) -> DataFrame:
    """urls with host, path, rule, score and verdict.

    Null or unparsable urls have an empty host and path and go by the model, like any other url that no rule
    fits. Columns of the input that have these five names are replaced, all others kept. An empty table stays empty.
    """
    host, path = F.col("host"), F.col("path")
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(a).alias("action"))) for a, h, p in rules]
    fit_rule = F.array_max(F.array_compact(F.array(*fits))) if fits else F.lit(None).cast("struct<n:int,rule:string,action:string>")
    rows = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    best, w = unused(rows, "_best"), unused(rows, "_w")
    rows = rows.withColumns({best: fit_rule, w: model.select("w").scalar()})
    by_rule = F.col(best).isNotNull()
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-_margin(grams(host, path, buckets=buckets), F.col(w))))
    rows = rows.withColumn("score", F.when(~by_rule, score))
    return rows.withColumns({"rule": F.col(best)["rule"], "verdict": F.when(by_rule, F.col(best)["action"]).when(F.col("score") >= 0.5, "block").otherwise("allow")}).drop(best, w)

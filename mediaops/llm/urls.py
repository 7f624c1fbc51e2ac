"""URL filters: host and path rules, else a logistic regression on hashed character n-grams.

All of it is DataFrame expressions; the training runs as one expression over one small row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Verdicts by (host, path): a rule fits the host and its subdomains if the path starts with the rule's.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

#: The small labelled table: hosts with paths, to block or to allow. Fixed values.
BLOCKED = """
casino-royal.example/slots casino-online.example/play/1 casino-gold.example/en/12 best-casino.example/bonus free-casino.example/
poker-room.example/tables online-poker.example/join lucky-slots.example/spin/4 jackpot-city.example/win big-jackpot.example/en/3
bets-live.example/today bets-online.example/en/31 sports-bets.example/odds betting-tips.example/live bet-now.example/offer
discount-pills.example/buy pills-market.example/en/41 buy-pills.example/order diet-pills.example/fr/176 pills-online.example/de/9
viagra-shop.example/cheap cheap-meds.example/order/7 replica-watches.example/sale cheap-replica.example/bags pharmacy-cheap.example/
spam-mail.example/en/90 spam-links.example/1 link-farm.example/list/33 seo-spam.example/en/4 content-farm.example/page
ads-network.example/en/75 ads-server.example/banner/3 adserver.example/click track-click.example/r/99 banner-ads.example/img
click-track.example/out pop-ads.example/under tracker-ads.example/pixel ads.click.example/en/5 track.pixel.example/go
xxx-videos.example/watch porn-tube.example/1 adult-cams.example/live hot-porn.example/en/77 adult-xxx.example/free
payday-loans.example/apply fast-loans.example/cash free-money.example/win win-prize.example/claim cheap-loans.example/en/2
warez-crack.example/download crack-keys.example/serial free-warez.example/get malware-site.example/exe phishing-bank.example/login
""".split()
ALLOWED = """
daily-news.example/world/12 www.citynews.example/en/334 news.example/politics/9 evening-times.example/article/3 morning-post.example/en/8
blog.gardening.example/en/455 blog.travels.example/fr/65 blog.kitchen.example/recipes blog.history.example/en/519 myblog.example/2020/05
science-journal.example/papers/4 research.example/en/762 university.example/courses library.example/books/17 museum.example/exhibits
docs.software.example/guide/2 developer.example/api manual.example/en/471 wiki.example/page/Tree encyclopedia.example/en/676
weather.example/today sports-club.example/matches football.example/en/148 music-school.example/lessons theatre.example/program
cooking.example/soup/12 garden-tools.example/en/231 hiking.example/trails/5 photography.example/gallery art-history.example/en/929
town-hall.example/council ministry.example/reports health-clinic.example/advice hospital.example/en/40 school.example/calendar
www.thermal.example/en/618 m.river.example/en/25 mountain-hotel.example/en/81 brewery.example/de/61 vineyard.example/es/53
ceramics.example/en/17 orchestra.example/fr/44 shining.example/en/625 reading.example/es/978 nation.example/en/853
bookstore.example/new trains.example/times bakery.example/en/11 astronomy.example/stars forum.example/topic/88
""".split()

#: n-grams fall on so many places: three hexadecimal digits of their MD5. One more place holds the bias.
PLACES = 4096
LENGTHS = (3, 4)
STEPS = 200
SPEED = 8.0
RIDGE = 1e-4

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _CAPITALS, _SMALL), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule(host: Column, path: Column, rules) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, null if none does."""
    found = F.lit(None)
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _cut(text: Column, n: int):
    return lambda i: F.substr(text, i, F.lit(n))


def _places(host: Column, path: Column) -> Column:
    """The sorted distinct places of the n-grams of ``^host$`` and ``>path``, with the bias place last."""
    marked = (F.concat(F.lit("^"), host, F.lit("$")), F.concat(F.lit(">"), path))
    lists = [F.expr("array()").cast("array<string>")]
    for text in marked:
        for n in LENGTHS:
            last = F.char_length(text) - F.lit(n - 1)
            starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.expr("array()").cast("array<int>"))
            lists.append(F.transform(starts, _cut(text, n)))
    grams = F.array_distinct(F.concat(*lists))
    placed = F.transform(grams, lambda g: F.conv(F.substring(F.md5(g.cast("binary")), 1, 3), 16, 10).cast("int"))
    return F.concat(F.array_sort(F.array_distinct(placed)), F.array(F.lit(PLACES)))


def fit(spark: SparkSession, blocked: list[str] | None = None, allowed: list[str] | None = None) -> list[float]:
    """PLACES + 1 weights, fitted by gradient descent on the labelled hosts with paths.

    Every row's places count 1 / root of their number. The whole descent is one SQL expression over one row, as the
    labelled table is small and fixed (some hundred rows; give no more than ten thousand). No rows give zero weights.
    """
    rows = [(i, y, *u.partition("/")[::2]) for i, (u, y) in enumerate(
        [(u, 1.0) for u in (BLOCKED if blocked is None else blocked)] + [(u, 0.0) for u in (ALLOWED if allowed is None else allowed)])]
    if not rows:
        return [0.0] * (PLACES + 1)
    named = spark.createDataFrame([(i, y, h, "/" + p) for i, y, h, p in rows], "i int, y double, host string, path string")
    sparse = named.select("i", "y", _places(F.col("host"), F.col("path")).alias("at"))
    lines = sparse.selectExpr("i", "named_struct('at', at, 's', 1 / sqrt(size(at)), 'y', y) AS r").agg(
        F.expr("transform(array_sort(collect_list(struct(i, r))), x -> x.r) AS lines"))
    users = sparse.selectExpr("i", "explode(at) AS j").groupBy("j").agg(F.sort_array(F.collect_list("i")).alias("used"))
    places = spark.range(PLACES + 1).select(F.col("id").cast("int").alias("j")).join(users, "j", "left").agg(
        F.expr("transform(array_sort(collect_list(struct(j, coalesce(used, array()) AS used))), x -> x.used) AS places"))
    step = f"""
      transform(array(transform(lines, r ->
          (1 / (1 + exp(-r.s * aggregate(r.at, 0D, (z, j) -> z + w[j]))) - r.y) * r.s)),
        e -> transform(places, (used, j) ->
          w[j] - {SPEED}D * (aggregate(used, 0D, (g, i) -> g + e[i]) / {len(rows)} + {RIDGE}D * w[j])))[0]"""
    both = lines.withColumn("one", F.lit(1)).join(places.withColumn("one", F.lit(1)), "one")
    fitted = both.select(F.expr(f"aggregate(sequence(1, {STEPS}), array_repeat(0D, {PLACES + 1}), (w, t) -> {step}) AS w"))
    return list(fitted.first().w)


def judge(df: DataFrame, weights: list[float], url: str = "url", rules=RULES) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` (allow or block) to every row.

    The longest rule that fits decides; else the regression does (block above an even chance). A null url, or one
    without ``://``, has an empty host and path and is judged by the regression. Other columns pass through; columns
    with these names are replaced.
    """
    made = ["host", "path", "rule", "verdict"]
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in made]
    address = F.col(f"`{url}`").cast("string")
    vector = F.expr("array(" + ",".join(f"{w!r}D" if math.isfinite(w) else "0D" for w in weights) + ")")
    parts = df.select(*kept, host_of(address).alias("host"), path_of(address).alias("path"))
    ruled = parts.withColumn("__rule", _rule(F.col("host"), F.col("path"), rules))
    # only rows without a rule are scored; the sign of the sum does not depend on its scale
    score = F.aggregate(_places(F.col("host"), F.col("path")), F.lit(0.0), lambda z, j: z + F.get(vector, j))
    learned = F.when(score > 0, F.lit("block")).otherwise(F.lit("allow"))
    return ruled.select(*kept, "host", "path", F.col("__rule.rule").alias("rule"),
                        F.coalesce(F.col("__rule.verdict"), learned).alias("verdict"))

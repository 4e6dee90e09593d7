"""URL filters: rules for hosts and paths, and trust and distrust spread over the graph of hosts (DataFrame only).

Host edges: a page's host to every other host that its html links to (an href or src of any scheme, or without one, that
names a host; a relative link stays on the page's host and is no edge), and, as hosts of one site answer for each other, every
host to its parent domain and back, up to the domain of two labels. An edge counts once per pair of hosts. Trust is
personalised PageRank from the hosts of pages that a rule allows; distrust runs over the reversed edges from the hosts of
pages that a rule blocks. Seeds weigh by their pages. Ranks are whole numbers (millionths of a millionth of the mass), so
every run and every engine gets the same sums. A page without a rule is blocked if its host's distrust is over `ratio`
times its trust and over the mean mass of a host; otherwise it is allowed.

Edges of a host with more than `HUB` of them are dealt to `SALTS` parts, each of which meets its own copy of the host's share.

Defined results: a null url, or one without ://, has empty host and path and no rule; it is allowed unless distrusted.
An empty host takes no part in the graph. Repeated rows each give a row. No pages, links or seeds: all ranks are 0.
Of rules that fit, the one with the longest text wins, and of equally long ones the first in order of text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.llm.common import only, staged

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
ROUNDS, DAMPING, MASS, RATIO = 10, 85, 10**12, 1
HUB, SALTS = 10_000, 64
LINK = r"(?i)(?:href|src)\s*=\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^\"'/?#>\s]+)"
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or end, A-Z lower-cased; path: then up to ? # or end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UP, LOW), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Text of the winning rule, or null."""
    out = F.lit(None).cast("string")
    for text, _ in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):  # the last `when` set wins
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.lit(text)).otherwise(out)
    return out


def site_edges(hosts: DataFrame) -> DataFrame:
    """(src, dst): each host and its parent domain, both ways, up to the domain of two labels; addresses of digits have none."""
    up = F.explode(F.expr("CASE WHEN size(labels) > 2 AND NOT host RLIKE '^[0-9.:]+$' THEN sequence(3, size(labels)) END"))
    steps = (hosts.select("host", F.split("host", "\\.").alias("labels")).select("host", up.alias("k"))
             .select(F.expr("substring_index(host, '.', -k)").alias("a"), F.expr("substring_index(host, '.', 1 - k)").alias("b"))
             .where("a != '' and b != ''"))
    return steps.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(steps.select("b", "a")).where("src != dst").distinct()


def ranks(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS, hub: int = HUB, salts: int = SALTS) -> DataFrame:
    """(kind, host, rank) from seeds (kind, host, n) over edges (kind, src, dst), mass MASS a kind."""
    total = seeds.groupBy("kind").agg(F.sum("n").alias("all"))
    start = staged(seeds.join(F.broadcast(total), "kind")  # broadcast: two kinds
                   .select("kind", "host", F.expr(f"({MASS} * n) div all").alias("rank")), "seeds")
    degree = staged(edges.groupBy("kind", F.col("src").alias("host")).agg(F.count("*").alias("deg")), "degrees")
    hubs = degree.where(F.col("deg") > hub).select("kind", F.col("host").alias("src"), F.lit(salts).alias("parts"))
    step = staged(edges.join(hubs, ["kind", "src"], "left").select(
        "kind", "src", "dst", F.pmod(F.xxhash64("dst"), F.coalesce("parts", F.lit(1))).cast("int").alias("salt")), "links")
    now = start
    for i in range(rounds):
        share = now.join(degree, ["kind", "host"]).select(
            "kind", F.col("host").alias("src"), F.expr(f"(rank * {DAMPING}) div (100 * deg)").alias("rank"),
            F.explode(F.sequence(F.lit(0), F.when(F.col("deg") > hub, salts - 1).otherwise(0))).alias("salt"))
        sent = share.join(step, ["kind", "src", "salt"]).select("kind", F.col("dst").alias("host"), "rank")
        back = start.select("kind", "host", F.expr(f"(rank * {100 - DAMPING}) div 100").alias("rank"))
        now = sent.unionByName(back).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if i % 5 == 4:
            now = staged(now, "ranks")
    return now


def judge(pages: DataFrame, rules=RULES, rounds: int = ROUNDS, ratio: int = RATIO, hub: int = HUB) -> DataFrame:
    """page_id, host, path, rule and verdict of every page, with its host's trust and distrust."""
    host, path = host_and_path(F.col("url"))
    base = only(pages, "page_id", "url", "html").select("page_id", host.alias("host"), path.alias("path"), "html")
    verdicts = F.create_map(*[F.lit(x) for r in rules for x in r])
    linked = F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)), lambda x: F.translate(x, UP, LOW))
    # one pass over the html; what follows reads only hosts
    seen = staged(base.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("rule"),
                              F.array_distinct(linked).alias("to")), "pages")
    links = (seen.select(F.col("host").alias("src"), F.explode("to").alias("dst"))
             .where("src != dst and src != '' and dst != ''").distinct())
    links = staged(links, "host-links")
    known = seen.select("host").where("host != ''").union(links.select("dst")).distinct()
    edges = staged(links.union(site_edges(known)).distinct(), "edges")
    nodes = known.union(edges.select("src")).union(edges.select("dst")).agg(F.count_distinct("host").alias("hosts"))
    edges = (edges.select(F.lit("trust").alias("kind"), "src", "dst")
             .unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"))))
    seeds = (seen.where("rule is not null and host != ''").groupBy("host", "rule").agg(F.count("*").alias("n"))
             .select("host", "n", F.when(verdicts[F.col("rule")] == "allow", "trust").otherwise("distrust").alias("kind"))
             .groupBy("kind", "host").agg(F.sum("n").alias("n")))
    ranked = ranks(seeds, edges, rounds, hub).groupBy("host").pivot("kind", ["trust", "distrust"]).agg(F.sum("rank"))
    ranked = ranked.join(F.broadcast(nodes))  # one row
    ranked = staged(ranked.na.fill(0, ["trust", "distrust"]).select(
        "host", "trust", "distrust",
        ((F.col("distrust") > ratio * F.col("trust")) & (F.col("distrust") > F.expr(f"{MASS} div hosts"))).alias("bad")), "hosts")
    out = seen.drop("to").join(ranked, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce(
        verdicts[F.col("rule")], F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust"))


def op3(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))

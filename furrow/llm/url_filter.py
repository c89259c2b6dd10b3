"""URL filtering: given host rules first, association rules mined by FP-growth for the rest.

A url's tokens are its host's words and its path's first words. Spark's FP-growth mines token
sets that come with a verdict; rules pruned by support and confidence are posted under each of
their tokens, and a url matches a rule when as many of its tokens meet the rule's postings as
the rule has. Matching works on distinct token sets, so hosts of many pages are judged once.

FP-growth lists every subset of tokens that often occur together, so what can't change the rules is
taken out of the rows before it, and put back after it:

1. Tokens below the support go. Tokens that occur in exactly the same rows are one item, named by
   the smallest; a url has the item if it has one of its tokens.
2. Each item alone is counted. An item that always comes with one verdict is a rule, and a larger
   set with it is a rule that the item already makes as surely: no such set is mined.
3. A labelled url of at most ``MOST_ITEMS`` other items combines all of them. Of a longer one the best (by
   chi square, ties by name) are combined, and besides, where there is a longer one at all, every url combines
   its items of each two groups: all items lie in groups of ``GROUP``, by rank. So sets of any length within two groups,
   and with them all pairs of items, are counted over all urls; larger sets that spread wider are counted again over
   the whole labelled rows.
4. Where there is a longer url, all sets that spread wider, of any length, are then grown item by item over all whole urls
   (``_grown``). Only sets are left out that can't change a verdict of any url, now or seen later: those with too little support, those
   that occur where a part does, and those whose larger sets, by what must stay in their rows, are no rules,
   are beaten by a part, or are overruled. So every verdict is the one that all rules of any length make, and so it is without
   long urls, where all rules are listed. What is left may still be many sets, up to 2**k of k items that tell nothing: that takes time, nothing is cut.

A rule of which a smaller part makes the same verdict as surely is dropped (after the fourth step, if that part is listed).

A null url, or one without ``://``, has an empty host and path, no tokens, and is allowed. Rows
with equal ids or urls are judged alike, a very long url like any other. Of rules that fit, the
surest wins, then the better supported, the longer, and "block". Without pages the result is empty;
without labels no rule is mined and the rest is allowed. Other columns, whatever their names,
take no part.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch, stored

#: Fixed value: (verdict, host, path) of the given rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Bound of the labelled sample: rows with the lowest hashes of their ids.
FIT_ROWS = 20_000
SUPPORT, CONFIDENCE = 0.002, 0.8
#: Items that FP-growth mines in combination, and in a group; wider sets are grown, see above.
MOST_ITEMS, GROUP = 10, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, UPPER, LOWER), path


def given_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    name = verdict = F.lit(None).cast("string")
    for what, domain, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(prefix))
        name = F.when(fits, domain + prefix).otherwise(name)
        verdict = F.when(fits, what).otherwise(verdict)
    return name, verdict


def tokens(host: Column, path: Column) -> Column:
    """Sorted distinct words of host and path without the numeric ones."""
    words = lambda text, mark: F.transform(F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.rlike(r"^\p{N}+$")), lambda w: F.concat(F.lit(mark), w))
    return F.array_sort(F.array_distinct(F.concat(words(host, "host:"), words(path, "path:"))))


def _items(sets: DataFrame, rows: int) -> DataFrame:
    """token, item, block, allow, pure of frequent tokens: ``sets`` holds distinct (tokens, verdict) with n."""
    each = sets.select("verdict", "n", F.xxhash64("tokens").cast("decimal(38,0)").alias("_h"), F.explode("tokens").alias("token"))
    count = lambda verdict: F.sum(F.when(F.col("verdict") == verdict, F.col("n")).otherwise(0)).alias(verdict)
    found = each.groupBy("token").agg(count("block"), count("allow"), F.sum(F.col("_h") * F.col("n")).alias("_where"))
    found = found.where(F.col("block") + F.col("allow") >= SUPPORT * rows)
    same = found.groupBy("block", "allow", "_where").agg(F.min("token").alias("item"), F.collect_list("token").alias("_tokens"))
    pure = F.greatest("block", "allow") == F.col("block") + F.col("allow")
    return same.select(F.explode("_tokens").alias("token"), "item", "block", "allow", pure.alias("pure"))


def _told_apart(items: DataFrame, rows: int, blocked: int) -> DataFrame:
    """Items that aren't pure, with their rank by chi square."""
    n = F.col("block") + F.col("allow")
    gap = F.col("block") * F.lit(float(rows)) - n * F.lit(float(blocked))
    mixed = items.where("not pure").select("item", (gap * gap / (n * F.greatest(F.lit(rows) - n, F.lit(1)))).alias("_score")).distinct()
    return mixed.select("item", F.struct((-F.col("_score")).alias("s"), F.col("item").alias("i")).alias("rank"))


def _of_two_groups(held: DataFrame, ranks: DataFrame) -> DataFrame:
    """tag, items, verdict, n: the items of each url in each two groups, and in each one alone. Items lie in
    groups by their rank; there are at most 1 / SUPPORT items for each item of a url."""
    placed = ranks.withColumn("group", F.floor((F.row_number().over(W.orderBy("rank")) - 1) / GROUP).cast("int")).select("item", "group")  # frequent items, a bounded list
    own = held.where("not pure").join(placed, "item").groupBy("_row", "verdict", "n", "group").agg(F.collect_list("item").alias("items"))  # GROUP at most
    one = own.groupBy("_row", "verdict", "n").agg(F.sort_array(F.collect_list(F.struct("group", "items"))).alias("g"))
    two = one.select("verdict", "n", F.posexplode("g").alias("at", "x"), "g").select("verdict", "n", "x", F.explode(F.slice("g", F.col("at") + 1, F.size("g"))).alias("y"))
    both = F.when(F.col("x.group") == F.col("y.group"), F.col("x.items")).otherwise(F.concat("x.items", "y.items"))
    return two.select(F.concat_ws("-", "x.group", "y.group").alias("tag"), both.alias("items"), "verdict", "n")


def _postings(rules: DataFrame, *more: str) -> DataFrame:
    return rules.select("rule_id", *more, F.size("tokens").alias("need"), F.explode("tokens").alias("item"))


def mine(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From rows of (tokens, verdict): rule_id, tokens (of items), verdict, confidence, support; and
    the items: token, item."""
    sets = stored(labelled.where("verdict in ('block', 'allow')").groupBy("tokens", "verdict").agg(F.count("*").alias("n")), "url-sets")
    rows, blocked = sets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("verdict") == "block", F.col("n"))), F.lit(0))).first()
    items = stored(_items(sets, rows), "url-items", keep=True)
    # the rows with items for tokens: a set of tokens keeps its number of rows
    worded = sets.select(F.xxhash64("tokens", "verdict").alias("_row"), "verdict", "n", F.explode("tokens").alias("token"))
    held = worded.join(items, "token").select("_row", "verdict", "n", "item", "pure").distinct()
    ranked = held.where("not pure").join(_told_apart(items, rows, blocked), "item").groupBy("_row", "verdict", "n").agg(F.sort_array(F.collect_list("rank")).alias("_ranked"))
    best = F.transform(F.slice("_ranked", 1, MOST_ITEMS), lambda r: r.i)
    baskets = stored(ranked.select("_row", best.alias("items"), "verdict", "n", (F.size("_ranked") > MOST_ITEMS).alias("_cut")), "url-baskets")
    cut = baskets.agg(F.coalesce(F.bool_or("_cut"), F.lit(False))).first()[0]
    tagged = baskets.select(F.lit("").alias("tag"), "items", "verdict", "n")
    if cut:
        tagged = tagged.union(_of_two_groups(held, _told_apart(items, rows, blocked)))
    tagged = stored(tagged.select(F.transform(F.concat("items", F.array(F.concat(F.lit("="), "verdict"))), lambda i: F.concat("tag", F.lit("|"), i)).alias("items"), "n"), "url-tagged")
    total = tagged.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    alone = items.select(F.array("item").alias("tokens"), _sides(F.col("block") + F.col("allow"))).distinct()
    if not total:
        return stored(_needed(_rules(alone, rows)), "url-rules", keep=True), items.select("token", "item")
    # a share of the baskets, of which rows with pure items alone aren't; filtered exactly below
    support = min(1.0, max(1e-9, (SUPPORT * rows - 1e-6) / total))
    single = tagged.select("items", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("items")
    mined = FPGrowth(itemsCol="items", minSupport=support).fit(single).freqItemsets
    plain = mined.select(F.transform("items", lambda i: F.substring_index(i, "|", -1)).alias("items"), "freq", (~F.startswith(F.get("items", 0), F.lit("|"))).alias("exact"))
    known = plain.select(F.array_sort(F.filter("items", lambda i: ~F.startswith(i, F.lit("=")))).alias("tokens"), F.expr("substr(get(filter(items, i -> startswith(i, '=')), 0), 2)").alias("verdict"), F.col("freq").alias("n"), F.lit(True) if not cut else F.col("exact"))
    known = known.toDF("tokens", "verdict", "n", "exact").where("size(tokens) > 1")
    # a set of one group is counted with each other group, in part but where the url has that group
    known = stored(known.groupBy("tokens", "verdict").agg(F.max("n").alias("n"), F.bool_or("exact").alias("exact")) if cut else known, "url-frequent")
    made = known.where("verdict is not null").join(known.where("verdict is null").select("tokens", F.col("n").alias("all")), "tokens")
    rules = _needed(_rules(made.select("tokens", "all", "verdict", "n", "exact").union(alone.withColumn("exact", F.lit(True))), rows, "exact"))
    if cut:  # what spreads over more than two groups is counted over the whole labelled rows
        rules = stored(rules, "url-candidates")
        found = stored(rules.where("not exact").select("tokens").distinct().withColumn("rule_id", F.xxhash64("tokens")), "url-mined")
        met = held.join(_postings(found), "item").groupBy("rule_id", "need", "_row", "verdict", "n").agg(F.count("*").alias("got")).where("got = need")
        counted = met.groupBy("rule_id").agg(F.sum("n").alias("all"), *(F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(v) for v in ("block", "allow")))
        counted = _rules(found.join(counted, "rule_id").select("tokens", _sides(F.col("all"))), rows)
        rules = _grown_rules(held, items, stored(_needed(rules.where("exact").select(counted.columns).union(counted)), "url-narrow"), rows).withColumn("exact", F.lit(True))
    return stored(rules.drop("exact"), "url-rules", keep=True), items.select("token", "item")


def _level(classes: DataFrame, known: DataFrame | None, verdict: str, rows: int, least: float, top: float, ones: bool) -> tuple[DataFrame, DataFrame]:
    """One step of ``_grown``. ``classes``: prefix, _row, own, n, lasts: the sets of a row with the same items but the
    last. Returns the sets counted (items, all, n, best, live, most, open), and ``classes`` of live sets."""
    each = classes.select("prefix", "own", "n", F.explode("lasts").alias("last"))
    counted = each.groupBy("prefix", "last").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("own"), F.col("n")).otherwise(0)).alias("own_n"))
    counted = counted.where(F.col("own_n") >= SUPPORT * rows).withColumn("items", F.array_sort(F.concat("prefix", F.array("last"))))
    sure = F.round(F.col("own_n") / F.col("all"), 9)
    if known is None:
        counted = counted.withColumns({"_least": F.lit(None).cast("long"), "_best": F.lit(0.0), "_live": F.lit(True)})
    else:
        parts = counted.select("items", F.explode(F.transform("items", lambda i: F.array_remove(F.col("items"), i))).alias("_part"))
        met = parts.join(known.select(F.col("items").alias("_part"), "all", "best", "live"), "_part")
        counted = counted.join(met.groupBy("items").agg(F.min("all").alias("_least"), F.max("best").alias("_best"), F.bool_and("live").alias("_live")), "items")
    counted = counted.withColumn("best", F.greatest("_best", F.when(sure >= CONFIDENCE, sure).otherwise(0.0)))
    # live: a larger set may matter, whatever it adds; not so if it lies in one verdict, where a part does, or in what a part decides
    live = F.col("_live") & (F.col("all") > F.col("own_n")) & (F.col("_least").isNull() | (F.col("all") < F.col("_least"))) & ((F.col("best") <= top) | F.lit(ones))
    counted = stored(counted.select("prefix", "last", "items", "all", F.col("own_n").alias("n"), "best", live.alias("live")), "url-counted")
    mates = counted.where("live").groupBy("prefix").agg(F.sort_array(F.collect_list("last")).alias("mates"))  # items of one set at most
    classes = classes.join(mates, "prefix").withColumn("lasts", F.array_intersect("lasts", "mates")).where("size(lasts) > 0")
    after = F.size("mates") - F.array_position("mates", F.col("last"))
    # a row that has all later items is in every larger set's
    each = classes.select("prefix", "own", "n", "mates", F.size("lasts").alias("_size"), F.posexplode("lasts").alias("at", "last"))
    stays = F.when(~F.col("own") & (F.col("_size") - F.col("at") - 1 == after), F.col("n")).otherwise(0)
    stay = each.groupBy("prefix", "last").agg(F.sum(stays).alias("_stay"), F.max(after).alias("_after"))
    most = F.round(F.col("n") / (F.col("n") + F.col("_stay")), 9)
    sets = counted.join(stay, ["prefix", "last"], "left").withColumn("most", most)
    is_open = F.coalesce(F.col("live") & (F.col("_after") > 0) & (F.col("most") >= least) & (F.col("most") > F.col("best")) & ((F.col("best") <= top) | (F.lit(ones) & (F.col("most") >= 1))), F.lit(False))
    return sets.select("prefix", "last", "items", "all", "n", "best", "live", "most", is_open.alias("open")), classes.drop("mates")


def _grown(classes: DataFrame, verdict: str, rows: int, least: float, top: float, ones: bool) -> list[DataFrame]:
    """Tables of (items, all, n): the sets that may be rules for ``verdict`` with a confidence of ``least`` and more.
    A set takes later items, the frequent ones last. What speaks against it has a confidence of at
    most ``top`` or, with ``ones``, of 1. Sets with a surer part are grown only if they may reach 1 with ``ones``: else what
    overrules them overrules the part, and what the part overrules they would."""
    found, known = [], None
    while not classes.isEmpty():
        sets, classes = _level(classes, known, verdict, rows, least, top, ones)
        known = stored(sets, "url-grown")
        found.append(known.where((F.col("best") >= CONFIDENCE) & (F.round(F.col("n") / F.col("all"), 9) == F.col("best"))).select("items", "all", "n"))
        longer = classes.select("_row", "own", "n", "prefix", "lasts", F.posexplode("lasts").alias("at", "last")).where("at + 1 < size(lasts)")
        longer = longer.join(known.where("open").select("prefix", "last"), ["prefix", "last"])
        classes = stored(longer.select(F.concat("prefix", F.array("last")).alias("prefix"), "_row", "own", "n", F.expr("slice(lasts, at + 2, size(lasts))").alias("lasts")), "url-classes")
    return found


def _grown_rules(held: DataFrame, items: DataFrame, rules: DataFrame, rows: int) -> DataFrame:
    """``rules`` and those of any length that may change a verdict: rules for "block", of which "allow" may overrule
    some, and then rules for "allow" that may do so; a url that no rule fits is allowed anyway."""
    rank = F.row_number().over(W.orderBy(F.col("block") + F.col("allow"), "item")).cast("int")  # frequent items, a bounded list
    placed = stored(items.where("not pure").select("item", "block", "allow").distinct().select("item", rank.alias("rank")), "url-placed")
    whole = held.where("not pure").join(placed, "item").groupBy("_row", "verdict", "n").agg(F.sort_array(F.collect_list("rank")).alias("lasts"))
    whole = stored(whole.groupBy("lasts", "verdict").agg(F.sum("n").alias("n")).withColumn("_row", F.xxhash64("lasts", "verdict")), "url-whole")
    start = lambda v: whole.select(F.array().cast("array<int>").alias("prefix"), "_row", (F.col("verdict") == v).alias("own"), "n", "lasts")
    edges = lambda df, v: df.where(F.col("verdict") == v).agg(F.min("confidence"), F.max("confidence")).first()

    def named(found: list[DataFrame], v: str) -> DataFrame:
        for df in found:
            names = df.select("items", "all", "n", F.explode("items").alias("rank")).join(placed, "rank").groupBy("items", "all", "n")
            yield _rules(names.agg(F.array_sort(F.collect_list("item")).alias("tokens")).select("tokens", "all", F.lit(v).alias("verdict"), "n"), rows).select(*columns)

    columns = ["tokens", "verdict", "confidence", "support"]
    rules = rules.select(*columns)
    # the most that an "allow" may reach: of an item alone, or with any others
    reach = _level(start("allow"), None, "allow", rows, CONFIDENCE, 1.0, False)[0].agg(F.max("most")).first()[0] or 0.0
    ones = edges(rules, "allow")[1] == 1  # those of items that always come with "allow", at least
    for df in named(_grown(start("block"), "block", rows, CONFIDENCE, reach if reach >= CONFIDENCE else 0.0, ones), "block"):
        rules = rules.union(df)
    rules = stored(rules.distinct(), "url-blocking")
    least, ones = edges(rules, "block")
    top = edges(rules.where("confidence < 1"), "block")[1] or 0.0
    if least is not None:
        for df in named(_grown(start("allow"), "allow", rows, least, top, ones == 1), "allow"):
            rules = rules.union(df)
    return _needed(stored(rules.distinct(), "url-both"), True)


def _sides(total: Column) -> Column:
    """Rows of all, verdict and n from the columns ``block`` and ``allow``."""
    return F.inline(F.array(*(F.struct(total.alias("all"), F.lit(v).alias("verdict"), F.col(v).alias("n")) for v in ("block", "allow"))))


def _rules(counted: DataFrame, rows: int, *more: str) -> DataFrame:
    """Those of (tokens, all, verdict, n) with support and confidence enough."""
    rules = counted.select("tokens", "verdict", "n", *more, F.round(F.col("n") / F.col("all"), 9).alias("confidence"), F.round(F.col("n") / F.lit(max(rows, 1)), 9).alias("support"))
    return rules.where((F.col("n") >= SUPPORT * rows) & (F.col("confidence") >= CONFIDENCE)).drop("n")


def _needed(rules: DataFrame, long: bool = False) -> DataFrame:
    """``rules`` without those of which a smaller part makes the same verdict as surely. A rule of k
    items asks for each of its 2**k parts by the parts' hashes, sums of the items' without carry; what
    answers is then compared item by item. Of more than ``MOST_ITEMS`` items (``long``) it looks for them by its items'
    postings instead."""
    rules = rules.withColumn("rule_id", F.xxhash64("tokens", "verdict"))
    hashes = F.transform("tokens", lambda t: F.xxhash64(t))
    every = F.aggregate(hashes, F.array(F.lit(0).cast("long")), lambda acc, h: F.concat(acc, F.transform(acc, lambda x: x.bitwiseXOR(h))))
    own = F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc.bitwiseXOR(h))
    parts = rules.where(F.size("tokens").between(2, MOST_ITEMS)).select("rule_id", "verdict", "confidence", F.explode(every).alias("part"))
    smaller = rules.select(own.alias("part"), "verdict", F.col("confidence").alias("_sure"), F.col("tokens").alias("_tokens"))
    met = parts.join(smaller, ["part", "verdict"]).where("_sure >= confidence").select("rule_id", "_tokens")
    within = (F.size("_tokens") < F.size("tokens")) & (F.size(F.array_except("_tokens", "tokens")) == 0)
    beaten = met.join(rules.select("rule_id", "tokens"), "rule_id").where(within).select("rule_id").distinct()
    if long:
        wide = rules.where(F.size("tokens") > MOST_ITEMS).select("rule_id", "verdict", "confidence", F.size("tokens").alias("_size"), F.explode("tokens").alias("item"))
        part = _postings(rules, "verdict", F.col("confidence").alias("_sure")).withColumnRenamed("rule_id", "part")
        met = wide.join(part, ["item", "verdict"]).where("_sure >= confidence and need < _size")
        beaten = beaten.union(met.groupBy("rule_id", "part", "need").agg(F.count("*").alias("got")).where("got = need").select("rule_id")).distinct()
    return rules.join(beaten, "rule_id", "left_anti")


def match(pages: DataFrame, rules: DataFrame, items: DataFrame) -> DataFrame:
    """``pages`` (with ``tokens``) and ``mined``: the verdict of the surest rule, null if none fits."""
    keyed = pages.withColumn("_set", F.array_join("tokens", " "))
    sets = keyed.select("_set", "tokens").distinct()
    own = sets.select("_set", F.explode("tokens").alias("token")).join(items, "token").select("_set", "item").distinct()
    met = own.join(_postings(rules, "verdict", "confidence", "support"), "item")
    full = met.groupBy("_set", "rule_id").agg(F.count("*").alias("got"), *(F.first(c).alias(c) for c in ("verdict", "confidence", "support", "need"))).where("got = need")
    best = full.groupBy("_set").agg(F.max_by("verdict", F.struct("confidence", "support", "need", "verdict")).alias("mined"), F.count("*").alias("n_rules"))
    return keyed.join(best, "_set", "left").drop("_set")


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns. ``labels``: id of a page and ``bad`` (0 or 1); the verdict of a
    given rule, where one fits, is a page's label before that."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = given_rule(F.col("host"), F.col("path"))
    parts = parts.select("*", rule.alias("rule"), verdict.alias("given"), tokens(F.col("host"), F.col("path")).alias("tokens"))
    known = parts.join(labels.select(F.col("id").alias("page_id"), "bad"), "page_id", "left")
    known = known.select("page_id", "tokens", F.coalesce("given", F.when(F.col("bad") == 1, "block").when(F.col("bad") == 0, "allow")).alias("verdict"))
    chosen = known.where("verdict is not null").orderBy(F.xxhash64("page_id"), "page_id", "tokens", "verdict").limit(FIT_ROWS)
    with scratch(pages.sparkSession):
        rules, items = mine(stored(chosen, "url-labelled"))
    out = match(parts, rules, items)
    return out.select("page_id", "host", "path", "rule", F.coalesce("given", "mined", F.lit("allow")).alias("verdict"), F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"))

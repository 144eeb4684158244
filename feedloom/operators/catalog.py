"""Feed-catalogue analytics: distinct subscribers, tag vocabulary, duplicate users, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_RATIO = 1.0


def subscriber_stats(subs: DataFrame) -> DataFrame:
    """subs(feed, user, country, paid): distinct subscribers per feed and country, and how many of them pay."""
    return subs.groupBy("feed", "country").agg(F.count_distinct("user").alias("users"), F.count_distinct(F.when(F.col("paid"), F.col("user"))).alias("paid_users"))


#: Countries whose users weigh half.
HALF = ("RU", "UA", "BY")


def _weight(country: str) -> Column:
    return F.when(F.col(country).cast("string").isin(*HALF), 0.5).otherwise(1.0)


def paid_ratio(users: DataFrame) -> DataFrame:
    """users(country, paid): share of paying users per country, weighted."""
    return users.groupBy("country").agg(F.avg(F.col("paid").cast("int")).alias("ratio")).withColumn("ratio", F.col("ratio") * _weight("country"))


def normalized_subscribers(stats: DataFrame, ratios: DataFrame) -> DataFrame:
    """The larger of the weighted sum of paid users and the sum of users times their country's ratio (1 where unknown)."""
    rows = stats.join(ratios, "country", "left").withColumn("ratio", F.coalesce("ratio", F.lit(DEFAULT_RATIO)))
    return rows.groupBy("feed").agg(F.greatest(F.sum(F.col("paid_users") * _weight("country")), F.sum(F.col("ratio") * F.col("users"))).alias("nsubs"))


def tag_vocabulary(tags: DataFrame, least: int = 5, least_kept: int = 2, also: DataFrame | None = None) -> DataFrame:
    """tags(feed, tag, user): tags that enough users of one feed use (or that are in ``also``) are the vocabulary; each
    feed keeps those of them that enough of its users use."""
    per_feed = tags.groupBy("feed", "tag").agg(F.count_distinct("user").alias("users"))
    words = per_feed.filter(F.col("users") >= least).select("tag").distinct()
    if also is not None:
        words = words.unionByName(also.select("tag")).distinct()
    return per_feed.filter(F.col("users") >= least_kept).join(words, "tag", "left_semi")


def top_tags(tags: DataFrame, least: int = 10, by: list[str] | None = None) -> DataFrame:
    """Tags by distinct users, most first, names in order among equals."""
    keys = [*(by or []), "tag"]
    return tags.groupBy(*keys).agg(F.count_distinct("user").alias("users")).filter(F.col("users") >= least).orderBy(*(by or []), F.col("users").desc(), "tag")


def catalogue(tags: DataFrame, n: int = 10) -> DataFrame:
    """A row for each feed: its top tags in order, the first as category; tags(feed, tag, users)."""
    w = Window.partitionBy("feed").orderBy(F.col("users").desc(), "tag")
    top = tags.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n)
    out = top.groupBy("feed").agg(F.sort_array(F.collect_list(F.struct("_n", "tag"))).alias("_t"))
    return out.select("feed", F.col("_t.tag").alias("tags"), F.col("_t")[0]["tag"].alias("category"))


#: Users with the same list that go together, users of a feed that are compared in one place, words of bits for the most
#: read feeds, pairs that may be compared in one task, pairs in which duplicates are sought at once, and how many times
#: more may be compared to find so many.
GROUP, TILE, WORDS, TASK, BLOCK, LOOK = 64, 4096, 4, 1 << 24, 1 << 20, 128


def _lists(subs: DataFrame, percent: int) -> DataFrame:
    """user, feeds (rarest first), n (a null feed counts), w0, w1, ... (a bit for each of the most read feeds), rest (the
    other feeds): those who can be like anyone at all; subs(user, feed)."""
    from ..shared import staged

    own = staged(subs.filter(F.col("user").isNotNull()).select("user", "feed").distinct(), "subscriptions")
    readers = own.groupBy("feed").agg(F.count("*").alias("readers"))
    most = readers.filter(F.col("feed").isNotNull()).orderBy(F.col("readers").desc(), "feed").limit(64 * WORDS)
    bits = most.select("feed", (F.row_number().over(Window.orderBy(F.col("readers").desc(), "feed")) - 1).alias("bit"))
    known = F.when(F.col("feed").isNotNull(), F.struct("readers", "feed"))
    word = lambda k: F.coalesce(F.bit_or(F.when(F.floor(F.col("bit") / 64) == k, F.expr("shiftleft(1L, bit % 64)"))), F.lit(0).cast("long")).alias(f"w{k}")
    rest = F.collect_list(F.when(F.col("bit").isNull(), F.col("feed"))).alias("rest")
    rows = own.join(readers, "feed", "left").join(F.broadcast(bits), "feed", "left")
    lists = rows.groupBy("user").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(known)).alias("_f"), *map(word, range(WORDS)), rest)
    out = lists.withColumn("feeds", F.col("_f.feed")).drop("_f")
    return staged(out.filter((F.size("feeds") > 0) & (F.size("feeds") * 100 >= F.col("n") * percent)), "lists")


def _judged() -> list[str]:
    return ["n", *(f"w{k}" for k in range(WORDS)), "rest"]


def _common() -> list[Column]:
    """What users with one list have in common."""
    return [F.first(c).alias(c) for c in _judged()[1:]]


def _classes(lists: DataFrame) -> DataFrame:
    """A row for each list: its first user and the number of its users."""
    return lists.groupBy("feeds", "n").agg(F.min("user").alias("first"), F.count("*").alias("copies"), *_common())


def _groups(rows: DataFrame, percent: int) -> DataFrame:
    """rows(users, feeds, ...) with an id, and near: of n feeds the n - ceil(n * percent / 100) + 1 rarest. Lists that are
    alike have one of these in common, so widely read feeds make few pairs."""
    from ..shared import staged

    near = F.slice("feeds", 1, (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))
    return staged(rows.select(F.array_min("users").alias("id"), "users", *_judged(), near.alias("near")), "groups")


def _meets(a: DataFrame, b: DataFrame) -> tuple[bool, float]:
    """Whether fewer users meet at rare feeds than there are pairs of users, and the lesser number."""
    users = F.sum(F.size("users")).cast("double")
    at = lambda x, s: x.select("users", F.explode("near").alias("feed")).groupBy("feed").agg(users.alias(s))
    rare = at(a, "a").join(at(b, "b"), "feed").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0.0))).first()[0]
    one = a.agg(users).first()[0] or 0.0
    every = one * (one if a is b else b.agg(users).first()[0] or 0.0)
    return rare < every, min(rare, every)


def _met(a: DataFrame, b: DataFrame, percent: int, how: str) -> DataFrame:
    """Join of the groups that are alike, with shared; of one table with itself, each pair once.

    They meet at their rare feeds, or all with all where that is less. A pair is judged where it is met, at the smallest
    of those feeds that both have, and goes nowhere else: only lists are shuffled. Groups that meet are cut into tiles,
    so no feed is too much for one task. The most read feeds in common are counted as bits; other feeds are looked at
    only if there can be enough of them."""
    same, (rare, meets) = a is b, _meets(a, b)
    tiles = F.ceil(F.sum(F.size("users")) / TILE)
    if rare:
        a_each, b_each = (x.withColumn("feed", F.explode("near")) for x in (a, b))
        cut = a_each.groupBy("feed").agg(tiles.alias("ta")).join(b_each.groupBy("feed").agg(tiles.alias("tb")), "feed")
        a_each, b_each, at = a_each.join(cut, "feed"), b_each.join(cut, "feed"), ["feed", "i", "j"]
    else:
        cut, at = [F.lit(x.agg(tiles).first()[0] or 1).alias(s) for x, s in ((a, "ta"), (b, "tb"))], ["i", "j"]
        a_each, b_each = a.select("*", *cut), b.select("*", *cut)
    parts = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int(meets / (TASK * (1 + same))), 20_000))
    first, own = F.lit(0).cast("long"), lambda s: [F.col(c).alias(c + s) for c in ("id", "users", "near", *_judged())]
    left = a_each.withColumn("i", F.pmod(F.xxhash64("id"), "ta")).select(*at[:-1], F.explode(F.sequence(F.col("i") if same else first, F.col("tb") - 1)).alias("j"), *own("_a"))
    right = b_each.withColumn("j", F.pmod(F.xxhash64("id"), "tb")).select(*at[:-2], F.explode(F.sequence(first, F.col("j") if same else F.col("ta") - 1)).alias("i"), "j", *own("_b"))
    bits = sum((F.bit_count(F.col(f"w{k}_a").bitwiseAND(F.col(f"w{k}_b"))) for k in range(WORDS)), F.lit(0))
    others = F.when((F.size("rest_a") > 0) & (F.size("rest_b") > 0), F.size(F.array_intersect("rest_a", "rest_b"))).otherwise(0)
    like = lambda shared: shared * 100 >= F.greatest("n_a", "n_b") * percent
    met = like(bits + F.least(F.size("rest_a"), F.size("rest_b"))) & like(bits + others)
    if same:
        met &= (F.col("i") != F.col("j")) | (F.col("id_a") <= F.col("id_b"))
    if same and rare:
        met &= F.array_min(F.array_intersect("near_a", "near_b")) == F.col("feed")
    right = right.repartition(parts, *at).withColumnsRenamed({c: f"{c}_b" for c in at})
    out = left.repartition(parts, *at).join(right, [*(F.col(c) == F.col(f"{c}_b") for c in at), met], how)
    return out if how == "left_semi" else out.withColumn("shared", (bits + others).cast("long"))


def _linked(groups: DataFrame, percent: int) -> DataFrame:
    """Groups of users with one list -> a < b, shared, sameness of all users that are alike."""
    like = _met(groups, groups, percent, "inner").withColumn("sameness", F.floor(100 * F.col("shared") / F.greatest("n_a", "n_b")).cast("long"))
    users = like.select((F.col("id_a") == F.col("id_b")).alias("one"), F.explode("users_a").alias("x"), "users_b", "shared", "sameness")
    users = users.select("one", "x", F.explode("users_b").alias("y"), "shared", "sameness").filter(~F.col("one") | (F.col("x") < F.col("y")))
    return users.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared", "sameness")


def similar_users(subs: DataFrame, percent: int = 70) -> DataFrame:
    """Pairs a < b that share at least ``percent`` of the larger list; subs(user, feed). Equal lists are compared once for
    each ``GROUP`` of their users."""
    lists = _lists(subs, percent)
    part = F.pmod(F.xxhash64("user"), F.ceil(F.col("copies") / GROUP)).alias("part")
    rows = lists.join(_classes(lists).select("feeds", "n", "copies"), ["feeds", "n"])
    return _linked(_groups(rows.groupBy("feeds", "n", part).agg(F.collect_list("user").alias("users"), *_common()), percent), percent)


def _over(groups: DataFrame, percent: int) -> float:
    """Times more than may be looked through or written at once; what can be too many pairs is counted."""
    meets = _meets(groups, groups)[1]
    return meets / BLOCK if meets <= BLOCK else meets / BLOCK / LOOK if meets > BLOCK * LOOK else _linked(groups, percent).count() / BLOCK


def duplicate_subscribers(subs: DataFrame, percent: int = 70) -> DataFrame:
    """``duplicate_users`` of ``similar_users``. Users with one list have the same partners and each other, so whoever is
    not its first is a duplicate, and only first users need to be compared.

    Blocks of those, in the users' order and so small that few pairs are in them, are settled by their pairs; of later
    users, those like one that is kept are duplicates whatever else they are like, and are in no later block."""
    from ..shared import dropped, staged

    lists = _lists(subs, percent)
    classes = _classes(lists)
    out = lists.join(classes, ["feeds", "n"]).filter(F.col("user") != F.col("first")).select("user")
    left = _groups(classes.withColumn("users", F.array("first")), percent)
    while size := left.count():
        block, later = left, None
        while size > 2 and (times := _over(block, percent)) > 1:
            size = max(min(int(0.9 * size / times**0.5), size - 1), 2)
            end = left.select("id").orderBy("id").offset(size).first()[0]
            block, later = left.filter(F.col("id") < F.lit(end)), left.filter(F.col("id") >= F.lit(end))
        gone = staged(duplicate_users(_linked(block, percent)), "duplicates")
        out = out.unionByName(gone)
        if later is None:
            break
        kept = staged(block.join(gone, F.col("id") == F.col("user"), "left_anti"), "kept")
        like = staged(_met(later, kept, percent, "left_semi").select(F.col("id_a").alias("user")).distinct(), "duplicates")
        out, rest = out.unionByName(like), staged(later.join(like, F.col("id") == F.col("user"), "left_anti"), "groups")
        dropped(left)
        left = rest
    return out


def canonical_regroup(stats: DataFrame, feed: str, canonical: Column) -> DataFrame:
    """Users of a feed's variants join its canonical url's, where that url is itself in the table; stats(feed, user)."""
    urls = stats.select(F.col(feed).alias("_c")).distinct()
    rows = stats.withColumn("_to", canonical).join(urls, F.col("_to") == F.col("_c"), "left")
    return rows.select(F.coalesce("_c", F.col(feed)).alias(feed), "user").distinct()


def median0(c: str | Column) -> Column:
    """Median, mean of the middle two; 0 where there is none."""
    return F.coalesce(F.median(c), F.lit(0.0))


def posts_per_day(posts: DataFrame, least: int = 10, days: int = 7) -> DataFrame:
    """Posts a day back from the newest to the first that is the tenth or later and older than a week, or to the oldest;
    1 where there is no telling."""
    w = Window.partitionBy("feed").orderBy(F.col("time").desc(), F.col("post_idx").desc())
    age = (F.max(F.unix_micros("time")).over(Window.partitionBy("feed")) - F.unix_micros("time")) / 1_000_000.0
    rows = posts.select("feed", age.alias("age"), F.row_number().over(w).alias("n"))
    stop = F.min(F.when((F.col("n") >= least) & (F.col("age") > days * 86400), F.struct("n", "age")))
    found = rows.groupBy("feed").agg(F.coalesce(stop, F.max(F.struct("n", "age"))).alias("s"))
    one = (F.col("s.age") < 1) | (F.col("s.n") <= 1)
    return found.select("feed", F.when(one, 1.0).otherwise(F.try_divide(F.lit(86400.0), F.try_divide(F.col("s.age"), F.col("s.n") - 1))).alias("per_day"))


def size_score(words: Column, images: Column, videos: Column, links: Column) -> Column:
    """Distinct words of 3 to 29 letters, three for an image, five for a video, less one for a link; 0 at least."""
    own = F.size(F.array_distinct(F.filter(words, lambda w: F.length(w).between(3, 29))))
    return F.greatest(own + 3 * images + 5 * videos - links, F.lit(0))


def histogram(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def inter_arrival(events: DataFrame, key: str, time: str, minutes: int = 1) -> DataFrame:
    """Gaps between successive events in whole minutes, their number, and the share of gaps up to each."""
    w = Window.partitionBy(key).orderBy(time)
    gap = F.floor((F.unix_micros(time) - F.lag(F.unix_micros(time)).over(w)) / (60_000_000 * minutes))
    counts = events.select(gap.alias("gap")).filter("gap IS NOT NULL").groupBy("gap").agg(F.count("*").alias("n"))
    up = Window.orderBy("gap").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("upto", F.sum("n").over(up)).withColumn("share", F.col("upto") / F.sum("n").over(Window.partitionBy()))


def cohort_conversion(users: DataFrame, now, first: int = 30, last: int = 60) -> DataFrame:
    """Of those who signed up 30 to 60 days ago, how many pay."""
    age = (F.unix_timestamp(F.lit(now)) - F.unix_timestamp("signed_up")) / 86400.0
    rows = users.filter(age.between(first, last))
    return rows.agg(F.count("*").alias("users"), F.count_if("paid").alias("paid"), F.try_divide(F.count_if("paid"), F.count("*")).alias("ratio"))


def group_normalised(df: DataFrame, group: str, value: str) -> DataFrame:
    """log(value) to the base of the group's largest; 0 where that is 1."""
    top = F.max(value).over(Window.partitionBy(group))
    return df.withColumn("score", F.coalesce(F.try_divide(F.ln(value), F.ln(top)), F.lit(0.0)))


def _log(base: float, c: Column, at_zero: float) -> Column:
    """Logarithm with a value for what has none."""
    return F.coalesce(F.log(base, F.when(c > 0, c)), F.lit(at_zero))


def frequency_penalty(per_day: Column) -> Column:
    """1 up to one post a day, falling to a third at thirty-six."""
    return (3 - F.greatest(F.lit(0.0), F.least(F.lit(2.0), _log(6.0, per_day, 0.0)))) / 3


def length_penalty(score: Column) -> Column:
    """A third up to a size of ten, rising to 1 at a thousand."""
    return F.greatest(F.lit(1.0), F.least(F.lit(3.0), _log(10.0, score, 1.0))) / 3


def staleness_penalty(updated: Column, now) -> Column:
    """1 for every half year beyond a week without a post, 10 at most."""
    days = (F.unix_micros(F.lit(now)) - F.unix_micros(updated)) / 86_400_000_000.0
    return F.least(F.lit(10.0), F.greatest(F.lit(0.0), (days - 7) / (6 * 30)))


def specific_penalty(feed: Column, specific: tuple = ()) -> Column:
    return F.when(feed.isin(*specific), 0.5).otherwise(1.0) if specific else F.lit(1.0)


def _same(a: Column, tag: str) -> Column:
    """One begins the other, and neither is empty."""
    n = F.least(F.length(a), F.lit(len(tag)))
    return (n > 0) & (F.substring(a, F.lit(1), n) == F.substring(F.lit(tag), F.lit(1), n))


def tag_tier(tags: Column, asked: list[str], category: Column | None = None) -> Column:
    """The largest n for which just n of the asked tags are among the feed's first n tags (or are its category); 0 if none."""
    tiers = []
    for n in range(len(asked), 0, -1):
        first = F.slice(tags, 1, n)
        among = F.concat(first, F.array_compact(F.array(category))) if category is not None else first
        hits = sum((F.exists(among, _matcher(a)).cast("int") for a in asked), F.lit(0))
        tiers.append(F.when(hits == n, n))
    return F.coalesce(*tiers, F.lit(0))


def _matcher(tag: str):
    return lambda t: _same(t, tag)


def search(catalog: DataFrame, asked: list[str], country: str, now, specific: tuple = (), first: int = 350, last: int = 50) -> DataFrame:
    """Feeds that have all asked tags: constant scores (1, the country 1 and 1, the category 1000 a tag) choose the first
    350; these fall into tiers by tags, three apart, and within by the country's paying users (2), its users (1), others
    (0); in a group a feed's users, logarithmic to the group's largest, times its penalties, less its staleness. The best
    50 come back. catalog(feed, tags, category, paid_countries map, countries map, nsubs, per_day, post_len, updated);
    country "-" is none."""
    known = country != "-"
    hits = F.lit(True)
    for a in asked:
        hits = hits & F.exists("tags", _matcher(a))
    paid, all_ = (F.col(c).getItem(country) for c in ("paid_countries", "countries"))
    near = (paid.isNotNull().cast("int") + all_.isNotNull().cast("int")) if known else F.lit(0)
    score = 1 + near + 1000 * sum(((F.col("category") == a).cast("int") for a in asked), F.lit(0))
    order = [F.col("score").desc()] if known else []
    best = catalog.filter(hits).withColumn("score", score).orderBy(*order, F.col("nsubs").desc(), "feed").limit(first)
    step = F.when(paid.isNotNull(), 2).when(all_.isNotNull(), 1).otherwise(0) if known else F.lit(0)
    users = F.when(step == 2, paid.cast("double")).when(step == 1, all_.cast("double")).otherwise(F.col("nsubs"))
    rows = best.withColumn("tier", tag_tier(F.col("tags"), asked, F.col("category"))).withColumn("step", step).withColumn("users", users)
    top = F.max("users").over(Window.partitionBy("tier", "step"))
    share = F.coalesce(F.try_divide(F.ln(F.when(F.col("users") > 0, F.col("users"))), F.ln(F.when(top > 0, top))), F.lit(0.0))
    penalty = frequency_penalty(F.col("per_day")) * specific_penalty(F.col("feed"), specific) * length_penalty(F.col("post_len"))
    rank = share * penalty + 3 * F.col("tier") + F.col("step") - staleness_penalty(F.col("updated"), now)
    return rows.withColumn("rank", rank).orderBy(F.col("rank").desc(), "feed").limit(last)


def duplicate_users(pairs: DataFrame) -> DataFrame:
    """pairs(a < b) of similar users -> user: those who are like an earlier user that is not a duplicate itself.

    In rounds: whoever has no earlier undecided or kept partner is kept, and the partners of those are duplicates."""
    from ..shared import dropped, staged

    left, out = staged(pairs.select("a", "b"), "pairs"), None
    while left.limit(1).count():
        kept = left.select(F.col("a").alias("user")).distinct().join(left.select(F.col("b").alias("user")), "user", "left_anti")
        gone = staged(left.join(kept.select(F.col("user").alias("a")), "a", "left_semi").select(F.col("b").alias("user")).distinct(), "duplicates")
        out = gone if out is None else out.unionByName(gone)
        rest = left.join(gone.select(F.col("user").alias("a")), "a", "left_anti").join(gone.select(F.col("user").alias("b")), "b", "left_anti")
        done, left = left, staged(rest.join(kept.select(F.col("user").alias("a")), "a", "left_anti").select("a", "b"), "pairs")
        dropped(done)
    return out if out is not None else pairs.select(F.col("a").alias("user")).limit(0)

"""Matching: the pairs of records that reach the match threshold, with their scores.

A pair needs evidence from its e-mails to pass the usual thresholds: without any it scores 0.45 at most, and
with the same domain alone 0.48. So instead of listing the pairs of a block, the search joins on what a match
must have: the same domain with an equal or similar name, or the same address with a near date and amount.

Records that look alike to the scores are collapsed first, so copies cost nothing; `copies` keeps their
number. Keys with many rows are cut into tiles that go to different tasks. Nothing is capped or dropped.
Clusters need links and not the list of all matches; `match_links` gives as many as there are nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recurva.functions import similarity as sim
from recurva.functions.coerce import field_reader, first_non_null, parse_double
from recurva.operators.blocking import STRATEGIES, Strategy, key_array, with_source
from recurva.session import checkpointed

# Alias fields read by the scores.
EMAIL_FIELDS = ("email", "email_address", "owner_email", "contact_email")
NAME_FIELDS = ("name", "company_name", "company", "account_name")
TIME_FIELDS = ("created", "created_at", "signup_date")
AMOUNT_FIELDS = ("mrr", "amount", "revenue", "plan_amount")

MATCH_THRESHOLD = 0.50
REVIEW_LIMIT = 0.70
DOMAIN_ONLY_BEST = 0.48
EQUAL_NAME_SCORE = 0.53
TOLERANCE_DAYS = 3
TILE_ROWS = 2048
BROADCAST_KEYS = 100_000
FEW_NAMES = 16
_WORD_RATIO = 0.8 / 0.95

_ATTRIBUTES = ("raw_email", "raw_name", "email", "link", "domain", "blocked", "name", "micros", "zoned", "amount", "amount_bad", "keys")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly to all shuffle partitions, however few files they come from: a row is few bytes but much work here."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def record_profiles(records: DataFrame, source_order: Sequence[str] = (),
                    strategies: Sequence[Strategy] = STRATEGIES) -> DataFrame:
    """What the scores read of each record, and `profile`, a digest of it.

    Sources are ordered as given, then by name; the first source of a pair is its side `a`. `blocked` says that all
    records of the same link share a blocking key for certain, as they do by their domain; strategies other than the
    usual ones may leave that out.
    """
    rows = spread(with_source(records))
    read = field_reader(rows)
    email, name, time, amount = (first_non_null(read, f) for f in (EMAIL_FIELDS, NAME_FIELDS, TIME_FIELDS, AMOUNT_FIELDS))
    rank = F.lit("~")
    for place, source in enumerate(source_order):
        rank = F.when(F.col("source_type") == source, f"{place:06d}").otherwise(rank)
    usual = F.lit(all(s in strategies for s in STRATEGIES))
    rows = rows.select(
        "source_type", "record_id",
        F.concat(rank, F.lit(":"), "source_type").alias("source_rank"),
        email.alias("raw_email"), name.alias("raw_name"), sim.clean_email(email).alias("email"),
        F.when(name != "", F.lower(name)).alias("name"),
        time.alias("time"), amount.alias("amount"),
        key_array(rows, strategies).alias("keys"),
    )
    number = parse_double(F.col("amount"))
    rows = rows.withColumn("domain", sim.known_domain(F.col("email"))).select(
        *[c for c in rows.columns if c not in ("time", "amount")],
        "domain", F.coalesce("domain", "email").alias("link"),
        (F.col("domain").isNotNull() & usual).alias("blocked"),
        sim.iso_micros(F.col("time")).alias("micros"),
        F.coalesce(sim.iso_zoned(F.col("time")), F.lit(False)).alias("zoned"),
        F.when(F.col("amount") != "", number).alias("amount"),
        ((F.col("amount") != "") & number.isNull()).alias("amount_bad"),
    )
    return rows.withColumn("profile", F.md5(F.to_json(F.struct(*_ATTRIBUTES), {"ignoreNullFields": "false"})))


def match_nodes(profiles: DataFrame, listed_copies: int = BROADCAST_KEYS) -> DataFrame:
    """One row per source and profile, named after its smallest record, with the number of copies.

    Profiles that may occur twice are found first, by a number for each; if those are at most `listed_copies`, only their rows
    are sorted and shuffled. Reads the profiles more than once, so hand in checkpointed ones.
    """
    columns = ["source_type", "source_rank", "profile", "record_id", "copies", *_ATTRIBUTES]
    mark = F.xxhash64("source_type", "profile").alias("mark")
    repeated = checkpointed(profiles.groupBy(mark).count().where(F.col("count") > 1).select("mark"))
    if repeated.count() > listed_copies:
        nodes = _collapsed(profiles)
    else:
        marked, repeated = profiles.withColumn("mark", mark), F.broadcast(repeated)
        single = marked.join(repeated, "mark", "left_anti").withColumn("copies", F.lit(1).cast("long"))
        nodes = single.select(*columns).unionByName(_collapsed(marked.join(repeated, "mark", "left_semi")).select(*columns))
    return nodes.withColumn("node", F.concat_ws(":", "source_type", "record_id"))


def _collapsed(profiles: DataFrame) -> DataFrame:
    """Equal profiles of a source as one row; the digest goes first, as rows sorted by it are told apart by a few letters."""
    return profiles.groupBy("profile", "source_type", "source_rank").agg(
        F.min("record_id").alias("record_id"), F.count(F.lit(1)).alias("copies"),
        *[F.any_value(c).alias(c) for c in _ATTRIBUTES],
    )


def _side(nodes: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    return nodes.select(*[F.col(c) if c in keep else F.col(c).alias(f"{prefix}_{c}") for c in nodes.columns])


def tiled_join(left: DataFrame, right: DataFrame, on: Sequence[str], condition: Column,
               tile_rows: int | None = TILE_ROWS) -> DataFrame:
    """Equi-join on `on` in which a key with many rows becomes a grid of tiles.

    A key with n rows on both sides gets t = ceil(n / tile_rows) stripes per side; a left row meets every
    right stripe and the other way round, so each pair meets once and no task holds a whole key. The number of
    tasks is set, as a tile is few bytes but much work and would be merged with others by size. Keys are
    counted first: without large ones, or with None for the tiles, this is a plain join.
    """
    if tile_rows is None:
        return left.join(right, list(on)).where(condition)
    counts = left.select(*on).unionAll(right.select(*on)).groupBy(*on).count().where(F.col("count") > tile_rows)
    hot = counts.select(*on, F.ceil(F.col("count") / tile_rows).cast("int").alias("stripes"))
    hot_keys = hot.count()
    if hot_keys == 0:
        return left.join(right, list(on)).where(condition)
    if hot_keys <= BROADCAST_KEYS:
        hot = F.broadcast(hot)

    def striped(rows: DataFrame, own: str, other: str) -> DataFrame:
        stripes = F.coalesce(F.col("stripes"), F.lit(1))
        spread = F.pmod(F.xxhash64(*[c for c in rows.columns if c in ("a_node", "b_node", "a_name", "b_name")]), stripes)
        return rows.join(hot, list(on), "left").withColumns({
            own: spread.cast("int"), other: F.explode(F.sequence(F.lit(0), stripes - 1)),
        }).drop("stripes")

    tiles = [*on, "stripe_a", "stripe_b"]
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = striped(left, "stripe_a", "stripe_b").repartition(tasks, *tiles)
    b = striped(right, "stripe_b", "stripe_a").repartition(tasks, *tiles)
    return a.join(b, tiles).where(condition).drop("stripe_a", "stripe_b")


# --- similar names ------------------------------------------------------------------------------


def _bigrams(text: Column) -> Column:
    """The two-letter pieces of a text, sorted."""
    pieces = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substr(text, i, F.lit(2)))
    return F.sort_array(F.when(F.length(text) >= 2, pieces).otherwise(F.array()))


def _numbered(pieces: str) -> Column:
    """Sorted pieces, all but the first of their kind with the number of their occurrence, so that sets behave like bags."""
    def numbered(piece: Column, i: Column) -> Column:
        earlier = i + 1 - F.array_position(pieces, piece)
        return F.when(earlier == 0, piece).otherwise(F.concat(piece, earlier.cast("string")))

    return F.when(F.size(F.array_distinct(pieces)) == F.size(pieces), F.col(pieces)).otherwise(F.transform(pieces, numbered))


def _bitmap(items: str, low: int) -> Column:
    """Bits of the items whose hash, out of 128, lies in the 64 from `low` on."""
    def add(bits: Column, item: Column) -> Column:
        place = F.pmod(F.xxhash64(item), F.lit(128)) - low
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))
        return F.when((place >= 0) & (place < 64), bits.bitwiseOR(bit)).otherwise(bits)

    return F.aggregate(items, F.lit(0).cast("long"), add)


def _name_features(names: DataFrame) -> DataFrame:
    """What the necessary condition reads of a name. `crowd`, if given, is the number of names of its link.

    The pieces of a text are worked out once where the ordered words give the same text. In links of few names all bits of the
    bitmaps are set, so that only the sets are compared: there the bitmaps would cost more than they save.
    """
    words = F.filter(F.split("name", r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")
    staged = names.withColumn("words", words).withColumns({
        "ordered": F.array_join(F.sort_array("words"), " "),
        "once": F.array_join(F.sort_array(F.array_distinct("words")), " "),
    })
    texts = {"grams": "name", "ordered_grams": "ordered", "once_grams": "once"}
    same = {"ordered_grams": ("grams", F.col("ordered") == F.col("name")), "once_grams": ("ordered_grams", F.col("once") == F.col("ordered"))}
    for work in (lambda grams: _bigrams(F.col(texts[grams])), _numbered):
        for grams in texts:
            known, equal = same.get(grams, (None, None))
            staged = staged.withColumn(grams, work(grams) if known is None else F.when(equal, F.col(known)).otherwise(work(grams)))
    crowded = F.col("crowd") > FEW_NAMES if "crowd" in names.columns else F.lit(True)
    bitmaps = {f"{items}_{low}": F.when(crowded, _bitmap(items, low)).otherwise(F.lit(-1).cast("long"))
               for items in ("words", *texts) for low in (0, 64)}
    return staged.withColumns({
        "length": F.length("name"),
        "ordered_length": F.length("ordered"),
        "once_length": F.length("once"),
        **bitmaps, **{f"{grams}_size": F.size(grams) for grams in texts},
    }).drop("ordered", "once", "crowd")


def _shared_at_most(items: str) -> Column:
    """Upper bound on the items two names share: those of one side less its bits that the other side lacks."""
    def bound(own: str, other: str) -> Column:
        lacking = [F.bit_count(F.col(f"{own}_{items}_{low}").bitwiseAND(F.bitwise_not(F.col(f"{other}_{items}_{low}"))))
                   for low in (0, 64)]
        return F.col(f"{own}_{items}_size") - lacking[0] - lacking[1]

    return F.least(bound("a", "b"), bound("b", "a"))


def _shared(items: str) -> Column:
    return F.size(F.array_intersect(f"a_{items}", f"b_{items}"))


def _covered(a_words: str, b_words: str) -> Column:
    """Whether the words two names share make up so much of either that the ratio of them to it suffices."""
    both = F.array_intersect(a_words, b_words)
    size = F.aggregate(both, F.lit(-1), lambda n, word: n + F.length(word) + 1)  # joined by blanks
    return size >= _WORD_RATIO / (2 - _WORD_RATIO) * F.least("a_once_length", "b_once_length") - 1e-9


def _enough_shared(shared: Callable[[str], Column], words: Column, covered: Column) -> Column:
    """Necessary condition for a fuzzy similarity of 0.80, from shared words and two-letter pieces.

    A ratio r of texts of length n and m shares at least (1.5 r − 1)(n + m) − 1 two-letter pieces. Texts of like length
    need a plain ratio of 0.8 or a word ratio of 0.8 / 0.95: of the sorted words; of the different words in the order of shared
    ones first, which changes at most two pieces on either side; or of the shared words to those of one of the names. Texts of unlike length, up to
    eight times, need a shared word or a window ratio of 0.8 / 0.9 or 0.8 / 0.855, against a window that is at least r / (2 − r) as
    long as the shorter text.
    """
    def least(column: str) -> Column:
        return F.least(f"a_{column}", f"b_{column}")

    def total(column: str) -> Column:
        return F.col(f"a_{column}") + F.col(f"b_{column}")

    def whole(ratio: float) -> float:
        return 1.5 * ratio - 1 - 1e-9

    def window(ratio: float) -> float:
        return whole(ratio) * (1 + ratio / (2 - ratio))

    longest = F.greatest("a_length", "b_length")
    alike = longest < 1.5 * least("length")
    plain = shared("grams") >= whole(0.8) * total("length") - 1
    near = shared("ordered_grams") >= whole(_WORD_RATIO) * total("ordered_length") - 1
    turned = words & ((shared("once_grams") >= whole(_WORD_RATIO) * total("once_length") - 5) | covered)
    inside = (shared("grams") >= window(0.8 / 0.9) * least("length") - 1) | (
        shared("ordered_grams") >= window(0.8 / 0.855) * least("ordered_length") - 1) | (
        shared("once_grams") >= window(0.8 / 0.855) * least("once_length") - 1)
    return plain | (alike & (near | turned)) | (~alike & (longest <= 8 * least("length")) & (words | inside))


def _may_be_similar() -> Column:
    """The necessary condition, first by bitmaps, which cost next to nothing, then by the sets themselves."""
    common_bits = (F.col("a_words_0").bitwiseAND(F.col("b_words_0")) != 0) | (
        F.col("a_words_64").bitwiseAND(F.col("b_words_64")) != 0)
    return _enough_shared(_shared_at_most, common_bits, F.lit(True)) & _enough_shared(
        _shared, F.arrays_overlap("a_words", "b_words"), _covered("a_words", "b_words"))


def _compared(pairs: DataFrame) -> DataFrame:
    """The distinct pairs of names with their similarity. Few bytes mean much work here, so they are spread out."""
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = pairs.select("a_name", "b_name").distinct().repartition(tasks, "a_name", "b_name")
    return distinct.withColumn("compared", sim.fuzzy_similarity("a_name", "b_name"))


def similar_names(nodes: DataFrame, tile_rows: int | None = TILE_ROWS) -> DataFrame:
    """Pairs of distinct names, both ways round, with a similarity of 0.80 or more.

    Only names that occur under one link (e-mail domain) in different sources are compared, once per link. Links with a single
    name or source are left out before anything is worked out of their names.
    """
    named = nodes.where(F.col("link").isNotNull() & F.col("name").isNotNull())
    names = named.groupBy("link", "name").agg(F.min("source_rank").alias("first"), F.max("source_rank").alias("last"))
    several = names.groupBy("link").agg(F.count(F.lit(1)).alias("crowd"), F.min("first").alias("least"), F.max("last").alias("most"))
    several = several.where("crowd > 1 AND least < most").select("link", "crowd")
    names = _name_features(spread(names.join(several, "link")))
    ordered = F.col("a_name") < F.col("b_name")
    across = (F.col("a_first") != F.col("b_last")) | (F.col("b_first") != F.col("a_last"))
    found = tiled_join(_side(names, "a", ("link",)), _side(names, "b", ("link",)), ["link"],
                       ordered & across & _may_be_similar(), tile_rows)
    compared = _compared(found).withColumnRenamed("compared", "similarity")
    close = compared.where(F.col("similarity") >= sim.NAME_FUZZY)
    swapped = close.select(F.col("b_name").alias("a_name"), F.col("a_name").alias("b_name"), "similarity")
    return close.unionByName(swapped)


# --- scores -------------------------------------------------------------------------------------


def _a(name: str) -> Column:
    return F.col(f"a_{name}")


def _b(name: str) -> Column:
    return F.col(f"b_{name}")


def _scores() -> dict[str, Column]:
    """The four scores of a pair, from the columns of both sides."""
    email = sim.score_email(_a("email"), _b("email"), _a("domain"), _b("domain"))
    name = sim.name_score(F.coalesce("similarity", F.lit(0.0)))
    temporal = sim.score_temporal(_a("micros"), _b("micros"), _a("zoned") == _b("zoned"), TOLERANCE_DAYS)
    amount = sim.score_amount(_a("amount"), _b("amount"))
    return {"email_score": email, "name_score": name, "temporal_score": temporal, "amount_score": amount}


def _evidence() -> Column:
    def said(score: str, method: Column, raw: str | None = None) -> Column:
        text = F.concat(method, F.lit(": "), _a(raw), F.lit(" <> "), _b(raw)) if raw else method
        return F.when(F.col(score) > 0, text)

    days = sim.day_distance(_a("micros"), _b("micros")).cast("string")
    return F.array_compact(F.array(
        said("email_score", sim.email_method(_a("email"), _b("email"), F.col("email_score")), "raw_email"),
        said("name_score", sim.name_method(_a("raw_name"), _b("raw_name"), F.col("similarity")), "raw_name"),
        said("temporal_score", F.concat(F.lit("temporal_match_"), days, F.lit("d"))),
        said("amount_score", sim.amount_method(_a("amount"), _b("amount"), _a("amount_bad") | _b("amount_bad"))),
    ))


_PAIR = ("a_source_type", "a_record_id", "b_source_type", "b_record_id", "a_node", "b_node", "a_copies", "b_copies",
         "email_score", "name_score", "temporal_score", "amount_score", "total_score", "evidence")


def _scored(pairs: DataFrame, threshold: float | None = None) -> DataFrame:
    cluster = [c for c in pairs.columns if c == "a_cluster_id"]
    scores = _scores()
    scored = pairs.withColumns({**scores, "total_score": sim.total_score(*scores.values())})
    if threshold is not None and sim.needs_rounding(threshold):
        scored = scored.where(F.col("total_score") >= threshold)
    return scored.withColumn("evidence", _evidence()).select(*_PAIR, *cluster)


def with_similarity(pairs: DataFrame) -> DataFrame:
    """Add the similarity of `a_name` and `b_name`; each distinct pair of names is compared once."""
    compared = _compared(pairs.where(F.col("a_name") != F.col("b_name")))
    similarity = F.when(F.col("a_name") == F.col("b_name"), 1.0).otherwise(F.col("compared"))
    return pairs.join(compared, ["a_name", "b_name"], "left").withColumn("similarity", similarity).drop("compared")


def score_pairs(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Score given pairs `a_source, a_id, b_source, b_id`; a pair with an unknown record is left out."""
    nodes = record_profiles(records).withColumns({
        "copies": F.lit(1).cast("long"), "node": F.concat_ws(":", "source_type", "record_id")})
    with_a = pairs.join(_side(nodes, "a"), (F.col("a_source") == _a("source_type")) & (F.col("a_id") == _a("record_id")))
    both = with_a.join(_side(nodes, "b"), (F.col("b_source") == _b("source_type")) & (F.col("b_id") == _b("record_id")))
    return _scored(with_similarity(both))


# --- search -------------------------------------------------------------------------------------


def _candidates(threshold: float) -> Column:
    """The sides, of one link, differ in source, share a blocking key, and score enough."""
    return (
        (_a("source_rank") < _b("source_rank")) & (_a("blocked") | F.arrays_overlap("a_keys", "b_keys"))
        & sim.reaches(threshold, *_scores().values())
    )


def _by_name(nodes: DataFrame, names: DataFrame, threshold: float, tile_rows: int | None,
             only: Column | None = None) -> DataFrame:
    """Matches of one link with equal or similar names; of those, only the ones asked for."""
    named = nodes.where(F.col("link").isNotNull() & F.col("name").isNotNull())
    a = _side(named, "a", ("link",))
    b = _side(named, "b", ("link",)).withColumn("other", _b("name"))
    same = a.withColumns({"other": _a("name"), "similarity": F.lit(1.0)})
    close = a.join(names.withColumnRenamed("b_name", "other"), "a_name")
    reach = same.unionByName(close)
    if only is not None:
        reach = reach.where(only)
    found = tiled_join(reach, b, ["link", "other"], _candidates(threshold), tile_rows)
    return found.drop("link", "other")


def _mixed_addresses(nodes: DataFrame) -> DataFrame:
    """The e-mails of several sources that come with different names or without one.

    Sources and names are compared by numbers, 128 bits each, which are aggregated without a sort.
    """
    numbers = {f"{c}_{i}": F.xxhash64(c, F.lit(i)) for c in ("source_rank", "name") for i in (1, 2)}
    differ = {c: F.lit(False) for c in ("source_rank", "name")}
    for column in numbers:
        kind = column[:-2]
        differ[kind] = differ[kind] | (F.col(f"low_{column}") < F.col(f"high_{column}"))
    ends = [end(c).alias(f"{word}_{c}") for c in numbers for word, end in (("low", F.min), ("high", F.max))]
    found = nodes.withColumns(numbers).groupBy("email").agg(F.max(F.col("name").isNull()).alias("nameless"), *ends)
    return found.where(differ["source_rank"] & (differ["name"] | F.col("nameless"))).select("email")


def _by_address(nodes: DataFrame, names: DataFrame, threshold: float, tile_rows: int | None) -> DataFrame:
    """Matches of one address with unlike names.

    They need a date within the tolerance, so the span of days is part of the join: two such dates lie in
    the same span or in neighbouring ones. Addresses of a single source, or whose records all have the same name, are left out
    before that.
    """
    dated = nodes.where(F.col("email").isNotNull() & F.col("micros").isNotNull()).drop("link")
    dated = dated.join(_mixed_addresses(dated), "email", "left_semi").withColumn(
        "span", F.floor(F.col("micros") / F.lit((TOLERANCE_DAYS + 1) * sim.DAY_MICROS)))
    near = dated.withColumn("span", F.explode(F.array(F.col("span") - 1, F.col("span"), F.col("span") + 1)))
    a = _side(dated, "a", ("span",)).withColumns({"address": _a("email"), "similarity": F.lit(0.0)})
    b = _side(near, "b", ("span",)).withColumn("address", _b("email"))
    unequal = ~F.coalesce(_a("name") == _b("name"), F.lit(False))
    found = tiled_join(a, b, ["address", "span"], unequal & _candidates(threshold), tile_rows)
    return found.drop("address", "span").join(names.select("a_name", "b_name"), ["a_name", "b_name"], "left_anti")


def _by_key(nodes: DataFrame, threshold: float, tile_rows: int | None) -> DataFrame:
    """Matches below the usual thresholds, where any shared key can lead to one.

    A pair is taken at the smallest key it shares, and only if it would reach the threshold with equal names.
    """
    keyed = nodes.drop("link").withColumn("key", F.explode("keys"))
    a, b = _side(keyed, "a", ("key",)), _side(keyed, "b", ("key",))
    at_best = F.when(_a("name").isNotNull() & _b("name").isNotNull(), 1.0).otherwise(0.0)
    first = F.array_min(F.array_intersect("a_keys", "b_keys")) == F.col("key")
    hopeful = a.withColumn("similarity", F.lit(None).cast("double"))
    best = {**_scores(), "name_score": at_best}
    condition = (_a("source_rank") < _b("source_rank")) & first & sim.reaches(threshold, *best.values())
    found = tiled_join(hopeful, b, ["key"], condition, tile_rows).drop("key", "similarity")
    return with_similarity(found).where(sim.reaches(threshold, *_scores().values()))


def needed_tiles(nodes: DataFrame, tile_rows: int | None) -> int | None:
    """`tile_rows` if a key of any of the joins can need tiles, else None.

    The keys are links or parts of links, and a node adds at most one row to either side of a key.
    """
    if tile_rows is None:
        return None
    sizes = nodes.where(F.col("link").isNotNull()).groupBy("link").count()
    return None if sizes.where(2 * F.col("count") > tile_rows).isEmpty() else tile_rows


def _sure(similarity: Column, threshold: float) -> Column:
    """The scores of a shared domain and of names this similar reach the threshold by themselves."""
    zero = F.lit(0.0)
    return sim.total_score(F.lit(0.8), sim.name_score(similarity), zero, zero) >= threshold


def match_pairs(nodes: DataFrame, threshold: float = MATCH_THRESHOLD, tile_rows: int | None = TILE_ROWS,
                names: DataFrame | None = None) -> DataFrame:
    """All pairs of nodes of different sources that share a blocking key and reach the threshold.

    Reads the nodes more than once, so hand in checkpointed ones; `names` are their `similar_names`, if known.
    """
    if threshold <= DOMAIN_ONLY_BEST:
        return _scored(_by_key(nodes, threshold, tile_rows), threshold)
    tile_rows = needed_tiles(nodes, tile_rows)
    if names is None:
        names = checkpointed(similar_names(nodes, tile_rows))
    found = _by_name(nodes, names, threshold, tile_rows)
    return _scored(found.unionByName(_by_address(nodes, names, threshold, tile_rows)), threshold)


def match_records(records: DataFrame, threshold: float = MATCH_THRESHOLD, source_order: Sequence[str] = (),
                  tile_rows: int = TILE_ROWS, strategies: Sequence[Strategy] = STRATEGIES) -> DataFrame:
    """`match_pairs` for records that are unique per source and id."""
    nodes = checkpointed(match_nodes(checkpointed(record_profiles(records, source_order, strategies))))
    return match_pairs(nodes, threshold, tile_rows)


def match_links(nodes: DataFrame, names: DataFrame, threshold: float = MATCH_THRESHOLD,
                tile_rows: int | None = TILE_ROWS) -> DataFrame:
    """Links `a_node, b_node` with the same connected components as the matches, without listing them all.

    Nodes of one domain share a blocking key, which those of an address without a domain may not. All nodes of
    one domain and one name match across sources whatever their dates and amounts, if the score
    of domain and name reaches the threshold by itself. Such a group takes one link per node, to its first
    node, and two groups with names similar enough take one link between their first nodes. Only pairs that
    also need a date or an amount are listed.
    """
    named = nodes.where(F.col("link").isNotNull() & F.col("name").isNotNull())
    groups = named.where("blocked").groupBy("link", "name").agg(
        F.min("node").alias("hub"), F.min("source_rank").alias("first"), F.max("source_rank").alias("last"))
    sure = names.where(_sure(F.col("similarity"), threshold))
    sides = groups.select("link", F.col("name").alias("a_name"), F.col("hub").alias("a_node"), "first", "last")
    others = groups.select("link", F.col("name").alias("b_name"), F.col("hub").alias("b_node"),
                           F.col("first").alias("other_first"), F.col("last").alias("other_last"))
    across = F.least("first", "other_first") != F.greatest("last", "other_last")
    between = sides.join(sure, "a_name").join(others, ["link", "b_name"]).where(across)
    linked = between.select("link", F.col("a_name").alias("name"))
    if threshold <= EQUAL_NAME_SCORE:
        linked = linked.unionByName(groups.where(F.col("first") != F.col("last")).select("link", "name"))
    joined = groups.join(linked.distinct(), ["link", "name"]).select("link", "name", "hub")
    within = named.where("blocked").join(joined, ["link", "name"]).select(F.col("hub").alias("a_node"), F.col("node").alias("b_node"))
    unsure = ~(_a("blocked") & _sure(F.col("similarity"), threshold))
    listed = _by_name(nodes, names, threshold, tile_rows, unsure).unionByName(_by_address(nodes, names, threshold, tile_rows))
    listed = _scored(listed, threshold).select("a_node", "b_node")
    return between.select("a_node", "b_node").unionByName(within).unionByName(listed)


def review_pairs(pairs: DataFrame, low: float = MATCH_THRESHOLD, high: float = REVIEW_LIMIT) -> DataFrame:
    """Pairs that match but should be looked at before they are merged."""
    return pairs.where((F.col("total_score") >= low) & (F.col("total_score") < high))

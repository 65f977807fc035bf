"""Stratified, quality-filtered sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.functions import rules as R
from larkspur.functions import text as T
from larkspur.operators.classify import row_quality, settled
from larkspur.operators.graph import connected_components
from larkspur.operators.ranks import ranked
from larkspur.sources.tables import discard, materialise


def exact_duplicate_groups(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(canonical, n) of canonical texts that more than one row has."""
    return docs.groupBy(T.canonical(F.col(text_col)).alias("canonical")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def token_sets(docs: DataFrame, id_col: str, text_col: str, *, least: int, keep_hashtags: bool = False, within: tuple[str, ...] = ()) -> DataFrame:
    """(id, within, form, tokens): the distinct words of texts that have ``least`` of them; equal sets have one ``form``."""
    rows = docs.select(F.col(id_col).alias("id"), *within, F.col(text_col).alias("text"))
    sets = settled(rows, tokens=F.array_sort(T.content_tokens(F.col("text"), R.STOP_WORDS, keep_hashtags=keep_hashtags)))
    return sets.where(F.size("tokens") >= least).select("id", *within, F.md5(F.array_join("tokens", " ").cast("binary")).alias("form"), "tokens")


def candidate_sets(sets: DataFrame, within: tuple[str, ...] = (), heavy: int = 10_000) -> DataFrame:
    """(within, a, b): different sets of (within, form, tokens), one row a form, that can share enough words; a is not the larger.

    A pair shares t = max(4, 70 % of the smaller set, rounded up) words. Words are put in one order, the rarest first. The first word that both
    share stands in either set where at least t words are left from it on: in the smaller set within its first n - t + 1, in the
    larger one at a place that the smaller set's t bounds too. Only such places meet. A word that more than
    ``heavy`` sets hold at such a place is split by set, so that no task takes all of them.
    """
    single = sets.select(*within, "form", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    common = single.groupBy(*within, "token").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy(*within, "form").orderBy("df", "token")
    placed = single.join(common, [*within, "token"]).withColumn("left", F.col("n") - F.row_number().over(order) + 1)
    placed = materialise(placed.where("left >= 4").withColumn("salts", F.ceil(F.col("df") / heavy).cast("int")).withColumn("t", F.greatest(F.lit(4), F.ceil(0.7 * F.col("n")).cast("int"))))
    a = placed.where("left >= t").select(*within, "token", F.col("form").alias("a"), F.col("n").alias("na"), "t", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    b = placed.select(*within, "token", F.col("form").alias("b"), F.col("n").alias("nb"), "left", F.pmod(F.xxhash64("form"), F.col("salts")).cast("int").alias("salt"))
    smaller = (F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))
    return a.join(b, [*within, "token", "salt"]).where(smaller & (F.col("left") >= F.col("t"))).select(*within, "a", "b").distinct()


def similar_sets(sets: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """(within, a, b, shared) of :func:`candidate_sets` that share enough words; ``sets`` has one row a form."""
    tokens = sets.select(*within, "form", "tokens")
    found = candidate_sets(sets, within)
    both = found.join(tokens.withColumnsRenamed({"form": "a", "tokens": "ta"}), [*within, "a"]).join(tokens.withColumnsRenamed({"form": "b", "tokens": "tb"}), [*within, "b"])
    both = settled(both, shared=F.size(F.array_intersect("ta", "tb")))
    # The larger set needs six words; which of the two is the candidate, and so needs them too, the caller knows.
    return both.where(T.near_duplicate(F.col("tb"), F.col("ta"), both_long=False)).select(*within, "a", "b", "shared", F.size("ta").alias("na"), F.size("tb").alias("nb"))


def forms_of(sets: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """(within, form, tokens, least, n): one row a form, with the least id that has it and the number of ids."""
    return sets.groupBy(*within, "form").agg(F.first("tokens").alias("tokens"), F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))


def near_duplicate_links(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, set_id, n_links): every text of six words with the least id of those with its words, and how many other texts pass the near-duplicate rule with it.

    Texts of equal words link to each other; they meet others as one. So copies cost rows, not pairs.
    """
    sets = materialise(token_sets(docs, id_col, text_col, least=6))
    forms = materialise(forms_of(sets))
    pairs = similar_sets(forms).select("a", "b")
    ways = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beside = ways.join(forms.select(F.col("form").alias("b"), "n"), "b").groupBy(F.col("a").alias("form")).agg(F.sum("n").alias("beside"))
    told = materialise(forms.join(beside, "form", "left").select("form", F.col("least").alias("set_id"), (F.col("n") - 1 + F.coalesce("beside", F.lit(0))).alias("n_links")))
    return sets.select("id", "form").join(told, "form").select("id", "set_id", "n_links")


def near_duplicate_pairs(docs: DataFrame, id_col: str, text_col: str, *, keep_hashtags: bool = False, most_listed: int = 500) -> DataFrame:
    """(left_id, right_id, shared): all pairs of texts of six words that pass the near-duplicate rule, left before right.

    Sets of words are compared once (see :func:`similar_sets`) and their texts paired at the end, copies with each other too, as
    the result asks for; :func:`near_duplicate_links` tells the same without listing the pairs.
    """
    sets = materialise(token_sets(docs, id_col, text_col, least=6, keep_hashtags=keep_hashtags))
    pairs = similar_sets(forms_of(sets)).select("a", "b", "shared").unionByName(sets.groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.first(F.size("tokens")).alias("shared")).where("n > 1").select(F.col("form").alias("a"), F.col("form").alias("b"), "shared"))
    # Copies come in lists of some ``most_listed`` ids, and it is pairs of lists that are dealt out, so a text's copies are not one task's pairs.
    counts = materialise(sets.groupBy("form").agg(F.count(F.lit(1)).alias("n")))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / most_listed)).alias("part")
    lists = materialise(sets.join(counts, "form").select("form", "id", part).groupBy("form", "part").agg(F.collect_list("id").alias("ids")))
    x, y = (lists.select(F.col("form").alias(form), F.col("part").alias(f"of_{ids}"), F.col("ids").alias(ids)) for form, ids in (("a", "xs"), ("b", "ys")))
    met = pairs.join(x, "a").join(y, "b").where((F.col("a") != F.col("b")) | (F.col("of_xs") <= F.col("of_ys"))).repartition("a", "b", "of_xs", "of_ys")
    one = (F.col("a") == F.col("b")) & (F.col("of_xs") == F.col("of_ys"))
    both = met.select("shared", "ys", one.alias("one"), F.explode("xs").alias("x")).select("shared", "one", "x", F.explode("ys").alias("y")).where(~F.col("one") | (F.col("x") < F.col("y")))
    return both.select(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id"), "shared")


def bucket_order(prefix: str = "") -> list[Column]:
    """Most evidence, most words, longest conversation, then time and id."""
    return [F.desc("evidence_strength"), F.desc("words"), F.desc("conversation_length"), T.message_time(F.col("created_at")).asc_nulls_last(), F.col("message_id").asc()]


def bucket_ranks(classified: DataFrame) -> DataFrame:
    return ranked(classified, ["bucket"], bucket_order(), "bucket_rank")


def quota_allocation(counts: DataFrame, total: int) -> DataFrame:
    """Largest remainders: (group, n, quota). Equal fractions go to the smaller group, then to the greater name."""
    raw = F.col("n") / F.sum("n").over(Window.partitionBy()) * total
    out = counts.withColumn("raw", raw).withColumn("quota", F.floor("raw"))
    left = F.lit(total) - F.sum("quota").over(Window.partitionBy())
    order = Window.orderBy(F.desc(F.col("raw") - F.col("quota")), "n", F.desc("group"))
    return out.withColumn("quota", F.col("quota") + F.when(F.row_number().over(order) <= left, 1).otherwise(0)).select("group", "n", F.col("quota").cast("long").alias("quota"))


def greedy_accept(items: DataFrame, conflicts: DataFrame, *, fold_items: int = 200, fold_links: int = 5_000) -> DataFrame:
    """Items in order, each accepted if it conflicts with no accepted earlier one: (item, accepted).

    ``conflicts`` has (earlier, later), where earlier sorts before later. Decisions depend on each other only inside a
    component of the conflicts: one of up to ``fold_items`` items and ``fold_links`` conflicts is decided by one fold over its items in
    order, all such components at once. Larger ones go by rounds: an item is decided once all earlier ones in conflict with it
    are, rejected if one of them is accepted, so there are at most as many rounds as the longest chain of
    conflicts of a large component has items.
    """
    conflicts = materialise(conflicts.select("earlier", "later").distinct())
    kind = conflicts.schema["later"].dataType.simpleString()
    if conflicts.where("earlier >= later").limit(1).count():
        raise ValueError("conflicts go in a circle: one names an item that sorts before the earlier one as the later")
    key = lambda c: F.to_json(F.struct(F.col(c).alias("item")))  # noqa: E731  (an item of any type as a string)
    labels = connected_components(conflicts.select(key("earlier").alias("earlier"), key("later").alias("later")), "earlier", "later")
    named = conflicts.select(F.explode(F.array("earlier", "later")).alias("item")).distinct().withColumn("node", key("item"))
    components = materialise(named.join(labels, "node").select("item", "component"))
    linked = conflicts.join(components.withColumnRenamed("item", "later"), "later")
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("n")).join(linked.groupBy("component").agg(F.count(F.lit(1)).alias("links")), "component")
    sizes = materialise(sizes.withColumn("small", (F.col("n") <= fold_items) & (F.col("links") <= fold_links)))
    small, large = (sizes.where(w).select("component") for w in ("small", "not small"))
    before = linked.join(small, "component").groupBy("component", F.col("later").alias("item")).agg(F.collect_list("earlier").alias("before"))
    held = components.join(small, "component").join(before, ["component", "item"], "left")
    rows = held.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("item", F.coalesce("before", F.array().cast(f"array<{kind}>")).alias("before")))).alias("rows"))
    taken = F.aggregate("rows", F.array().cast(f"array<{kind}>"), lambda done, row: F.when(F.arrays_overlap(done, row["before"]), done).otherwise(F.array_append(done, row["item"])))
    folded = rows.select(F.explode(F.array_except(F.transform("rows", lambda r: r["item"]), taken)).alias("item"))
    rejected = folded.select("item")
    if large.limit(1).count():
        still = components.join(large, "component").select("item")
        inside = conflicts.join(still.withColumnRenamed("item", "later"), "later", "left_semi")
        rejected = rejected.unionByName(_by_rounds(still, inside).where("not accepted").select("item"))
    rejected = materialise(rejected.withColumn("accepted", F.lit(False)))
    return items.select("item").join(rejected, "item", "left").select("item", F.coalesce("accepted", F.lit(True)).alias("accepted"))


def _by_rounds(items: DataFrame, conflicts: DataFrame) -> DataFrame:
    state = materialise(items.select("item", F.lit(None).cast("boolean").alias("accepted")))
    conflicts = materialise(conflicts)
    left = state.count()
    while left:
        seen = conflicts.join(state.select(F.col("item").alias("earlier"), F.col("accepted").alias("was")), "earlier")
        told = seen.groupBy(F.col("later").alias("item")).agg(F.max(F.coalesce("was", F.lit(False))).alias("beaten"), F.count_if(F.col("was").isNull()).alias("open"))
        decided = F.when(F.coalesce("beaten", F.lit(False)), False).when(F.coalesce("open", F.lit(0)) == 0, True)
        before, state = state, materialise(state.join(told, "item", "left").select("item", F.coalesce("accepted", decided).alias("accepted")))
        discard(before)
        left = state.where("accepted is null").count()
    discard(conflicts)
    return state


def intent_quotas(classified: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """(bucket, intent, quota): each bucket's quota, that of primary_intent dealt to its intents by :func:`quota_allocation`."""
    counts = classified.where("bucket = 'primary_intent'").groupBy(F.col("primary").alias("group")).agg(F.count(F.lit(1)).alias("n"))
    dealt = quota_allocation(counts, quotas["primary_intent"]).select(F.lit("primary_intent").alias("bucket"), F.col("group").alias("intent"), "quota")
    rest = [(b, "", k) for b, k in quotas.items() if b != "primary_intent"]
    return dealt.unionByName(classified.sparkSession.createDataFrame(rest, "bucket string, intent string, quota long"))


def quality_filtered(classified: DataFrame) -> DataFrame:
    """(message_id, bucket, intent, bucket_rank, reason): every row of each group, reason null where it is accepted.

    Groups are the buckets, primary_intent by intent. Rows bad in themselves have their own reason;
    of one canonical text only the first can be accepted; near duplicates of accepted rows of the group are not.
    Of rows with equal words the first stands for all: what makes it a near duplicate makes the others one, and
    where it is accepted they are near duplicates of it, if they have the six words that a near duplicate needs.
    """
    intent = F.when(F.col("bucket") == "primary_intent", F.col("primary")).otherwise("")
    rows = settled(bucket_ranks(classified), own=row_quality(F.col("text")), intent=intent)
    rows = materialise(rows.select("message_id", "bucket", "intent", "bucket_rank", "own", "text", F.md5(T.canonical(F.col("text")).cast("binary")).alias("canonical")))
    group = ("bucket", "intent")
    firsts = materialise(rows.where("own is null").groupBy(*group, "canonical").agg(F.min("bucket_rank").alias("first_rank")))
    rows = materialise(rows.join(firsts, [*group, "canonical"], "left"))
    sets = materialise(token_sets(rows.where("own is null and bucket_rank = first_rank"), "bucket_rank", "text", least=4, within=group))
    forms = materialise(forms_of(sets, group))
    # The later of two rows is the candidate, and only a candidate needs six words.
    pairs = similar_sets(forms, group).join(forms.select(*group, F.col("form").alias("a"), F.col("least").alias("x")), [*group, "a"]).join(forms.select(*group, F.col("form").alias("b"), F.col("least").alias("y")), [*group, "b"])
    pairs = pairs.where(F.when(F.col("x") < F.col("y"), F.col("nb")).otherwise(F.col("na")) >= 6)
    item = lambda place: F.struct(*group, place)
    conflicts = pairs.select(item(F.least("x", "y").alias("place")).alias("earlier"), item(F.greatest("x", "y").alias("place")).alias("later"))
    accepted = greedy_accept(forms.select(item(F.col("least").alias("place")).alias("item")), conflicts)
    told = forms.join(accepted.select("item.bucket", "item.intent", F.col("item.place").alias("least"), "accepted"), [*group, "least"])
    told = materialise(told.select(*group, "form", "least", (F.size("tokens") >= 6).alias("long"), "accepted"))
    redundant = ~F.col("accepted") | F.col("long") & (F.col("id") > F.col("least"))
    near = materialise(sets.join(told, [*group, "form"]).where(redundant).select(*group, F.col("id").alias("first_rank"), F.lit(True).alias("redundant")))
    rows = rows.join(near, [*group, "first_rank"], "left")
    reason = F.when(F.col("own").isNotNull(), F.col("own")).when(F.col("redundant"), "clearly_redundant_near_duplicate").when(F.col("bucket_rank") > F.col("first_rank"), "exact_duplicate")
    return rows.select("message_id", "bucket", "intent", "bucket_rank", reason.alias("reason"))


def pool_select(filtered: DataFrame, quotas: DataFrame) -> DataFrame:
    """(message_id, bucket, intent, pool_rank): the first ``quota`` accepted rows of each group, or all if there are fewer.

    ``filtered`` comes from :func:`quality_filtered`, ``quotas`` from :func:`intent_quotas`. Taking the
    first of all accepted rows equals stopping at the quota.
    """
    kept = ranked(filtered.where("reason is null").drop("reason"), ["bucket", "intent"], [F.col("bucket_rank").asc()], "pool_rank")
    return kept.join(F.broadcast(quotas), ["bucket", "intent"]).where("pool_rank <= quota").select("message_id", "bucket", "intent", "pool_rank")  # quotas: a row a group


def replacement_pairs(filtered: DataFrame, quotas: DataFrame, most: int = 10) -> DataFrame:
    """(bucket, intent, reason, rejected_id, replacement_id): the first ``most`` rejected rows of a group, each with the accepted row that took its place.

    Every accepted row takes the place of the first rejected one before it that still waits. With c
    accepted rows before the k-th rejected one, its replacement is accepted row k + max(c + 1 - k), the
    maximum over it and all rejected before it; rows beyond the quota replace nothing. A rejected row's place in
    its group less k is c, so no count runs over a group: only its first ``most`` rejected rows meet.
    """
    group, by_rank = ["bucket", "intent"], [F.col("bucket_rank").asc()]
    placed = ranked(filtered, group, by_rank, "place")
    first = ranked(placed.where("reason is not null"), group, by_rank, "k").where(F.col("k") <= most)
    waits = first.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("k", (F.col("place") - F.col("k")).alias("c"), "reason", "message_id"))).alias("w"))
    behind = F.transform("w", lambda x, i: F.struct(x["reason"].alias("reason"), x["message_id"].alias("rejected_id"), (x["k"] + F.array_max(F.transform(F.slice("w", 1, i + 1), lambda y: y["c"] + 1 - y["k"]))).alias("turn")))
    waits = waits.select(*group, F.explode(behind).alias("x")).select(*group, "x.*")
    taken = ranked(filtered.where("reason is null").drop("reason"), group, by_rank, "turn").select(*group, "turn", F.col("message_id").alias("replacement_id"))
    met = waits.join(taken, [*group, "turn"]).join(F.broadcast(quotas), group).where("turn <= quota")
    return met.select(*group, "reason", "rejected_id", "replacement_id")


def golden_select(pool: DataFrame, groups: DataFrame) -> DataFrame:
    """(message_id, place): rows of a bounded pool, group after group, that resemble nothing selected before, up to each group's quota.

    ``pool`` has message_id, text, bucket, intent and golden_rank, at most as many rows as the pool's
    quotas allow; ``groups`` has bucket, intent, turn and quota. Within a group rows come by
    golden_rank. One equal in canonical text or a near duplicate (both of six words) of a selected row
    of any group is skipped. Conflicts are found by joins; the decisions, each of which depends on
    all before it, are one fold over the pool in order.
    """
    dealt = pool.join(F.broadcast(groups), ["bucket", "intent"])
    order = Window.orderBy("turn", "golden_rank", "message_id")
    dealt = materialise(dealt.withColumn("place", F.row_number().over(order)).select("message_id", "text", "turn", "quota", "place", T.canonical(F.col("text"), keep_hashtags=True).alias("canonical")))
    near = near_duplicate_pairs(dealt, "place", "text", keep_hashtags=True).select("left_id", "right_id")
    first = Window.partitionBy("canonical").orderBy("place")
    # Of equal texts any selected one stands for all; the pairs of a copy with each earlier copy are bounded by the pool.
    equal = dealt.withColumn("copies", F.collect_list("place").over(first)).select(F.explode("copies").alias("left_id"), F.col("place").alias("right_id")).where("left_id < right_id")
    before = near.unionByName(equal).groupBy(F.col("right_id").alias("place")).agg(F.collect_set("left_id").alias("before"))
    rows = dealt.join(before, "place", "left").agg(F.array_sort(F.collect_list(F.struct("place", "turn", "quota", F.coalesce("before", F.array().cast("array<int>")).alias("before")))).alias("rows"))
    start = F.array().cast("array<struct<place:int,turn:int>>")

    def step(taken: Column, row: Column) -> Column:
        full = F.size(F.filter(taken, lambda t: t["turn"] == row["turn"])) >= row["quota"]
        alike = F.exists(taken, lambda t: F.array_contains(row["before"], t["place"]))
        one = F.array(F.struct(row["place"].alias("place"), row["turn"].cast("int").alias("turn")))
        return F.when(full | alike, taken).otherwise(F.concat(taken, one))

    chosen = rows.select(F.explode(F.aggregate("rows", start, step)).alias("t")).select("t.place")
    return dealt.join(chosen, "place").select("message_id", "place")


def seeded(seed: int, column: str) -> Column:
    """A portable random order: md5 of the seed and an id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(column)).cast("binary"))


def golden_ranks(tagged: DataFrame, seed: int = R.GOLDEN_SEED) -> DataFrame:
    """Within a bucket: most difficulty tags first, then seeded order, then id."""
    return ranked(tagged, ["bucket"], [F.desc(F.size("tags")), F.desc(seeded(seed, "message_id")), F.col("message_id").asc()], "golden_rank")


def golden_ids(selected: DataFrame) -> DataFrame:
    """GS-001 and on, by bucket, intent, time and id."""
    order = Window.orderBy("bucket", F.coalesce("primary", F.lit("")), T.message_time(F.col("created_at")).asc_nulls_first(), "message_id")
    return selected.withColumn("golden_id", F.format_string("GS-%03d", F.row_number().over(order)))


def seeded_sample(rows: DataFrame, id_col: str, n: int, seed: int = R.SAMPLE_SEED) -> DataFrame:
    return rows.orderBy(seeded(seed, id_col), id_col).limit(n)


def selection_sizes(selected: DataFrame, quotas: DataFrame) -> DataFrame:
    """(bucket, intent, wanted, selected, met) of every group with a quota."""
    have = selected.groupBy("bucket", "intent").agg(F.count(F.lit(1)).alias("selected"))
    told = quotas.join(have, ["bucket", "intent"], "left").na.fill(0, ["selected"])
    return told.select("bucket", "intent", F.col("quota").alias("wanted"), "selected", (F.col("selected") == F.col("quota")).alias("met"))


def check_selection(selected: DataFrame, quotas: DataFrame, *, complete: bool = True) -> None:
    """Raise unless every group has exactly its quota, or at most its quota if not ``complete``, and no message is there twice."""
    wrong = "not met" if complete else "selected > wanted"
    if found := selection_sizes(selected, quotas).where(wrong).limit(20).collect():
        raise ValueError(f"selection differs from its quotas: {[tuple(r) for r in found]}")
    if twice := selected.groupBy("message_id").count().where("count > 1").limit(20).collect():
        raise ValueError(f"selected more than once: {[r[0] for r in twice]}")

"""Rule evaluation: scoping, regex search with captures, thresholds and sequences.

``search_rules`` is the only operator that looks at messages. It evaluates all rules in one pass
over the logs, without a shuffle; only rows that match leave it. Thresholds and sequences then work
on those. Callers that use its result more than once should store it first
(``vigilog.session.stored``), as ``vigilog.plans.analysis`` does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilog.functions import literals
from vigilog.functions import lookups as L
from vigilog.functions import regex as R
from vigilog.functions.regex import sql_string
from vigilog.session import ship_code, stored
from vigilog.sources.rules import MAX_RULES, Rule, RuleSet

MICROS = 1_000_000
UNKNOWN_KEY = "unknown"
CELLS = 1024  # parts of one window length, so that no task owns a whole crowded window
FEW_LITERALS = 48  # so many are searched one by one
PARTS = 32  # cells of a threshold's window, and of a bucket of it
SALTS = 16  # parts of a key's hits where they meet the row that says the key fired
FEW_KEYS = 4096  # so many keys may be sent to every executor


# --------------------------------------------------------------------------- scope (D1)


def _scope_sql(rule: Rule, compat: bool) -> str:
    """SQL condition: the rule applies to this row."""
    if rule.service == "*" or (rule.service == "linux" and not compat):
        return "true"
    if rule.service == "auditd" and not compat:
        return "format = 'audit'"
    return f"contains(_service, {sql_string(rule.service)})"


def scope(logs: DataFrame, rules: RuleSet, *, compat: bool = False) -> DataFrame:
    """(service, rule_path) for every service seen and every enabled rule that applies to it.

    The services are reduced to distinct names before the rules, a bounded table, meet them.
    """
    services = logs.select("service", "format").distinct().withColumn("_service", F.lower("service"))
    tests = [
        f"CASE WHEN {_scope_sql(rule, compat)} THEN {sql_string(rule.path)} END"
        for rule in rules.active()
    ]
    paths = F.expr(f"array_compact(array({', '.join(tests)}))") if tests else F.expr("array('')")
    return (
        services.select("service", F.explode(paths).alias("rule_path"))
        .filter(F.col("rule_path") != "")
        .distinct()
    )


# --------------------------------------------------------------------------- search (D2, D3)


def search_rules(
    logs: DataFrame,
    rules: RuleSet,
    types: tuple = (),
    *,
    compat: bool = False,
    match_on: str | None = None,
    use_prefilter: bool = True,
    one_pass: bool = True,
) -> DataFrame:
    """One row per (entry, rule) hit; for sequence rules one per (entry, step) hit.

    The first pattern that occurs wins. ``captured`` holds the named groups (NULL: took no part),
    overridden by the entry's own extracted fields except in sequences. Each pattern is tried on the
    message. With ``match_on='raw'``, the default outside ``compat``, it is then tried on the whole line
    of access logs, whose message lacks the address, referer and user agent; 'message' does not.
    Required literals are found first: all in one pass over a line, by a function in Arrow batches,
    or, without ``one_pass`` or with few of them, each by Spark itself.
    """
    match_on = match_on or ("message" if compat else "raw")
    active = rules.active(*types)
    line = F.when(F.col("format") == "access", F.col("raw")) if match_on == "raw" else F.lit(None).cast("string")
    prepared = logs.withColumns({"_text": F.col("message"), "_line": line, "_both": F.concat_ws("\n", "message", line)}).select(
        "*", F.expr(R.prefilter_text("_both")).alias("_low"), F.lower("service").alias("_service")
    )
    whole = match_on == "raw"
    shared, any_of = {}, R.contains_any
    if use_prefilter:
        searched = [p for rule in active for p in (*rule.patterns, *rule.used_steps(compat))]
        words = tuple(sorted({word for p in searched for clause in R.gates(p) for word in clause}))
        if one_pass and literals.ahocorasick and len(words) >= FEW_LITERALS:
            ship_code(logs.sparkSession)
            prepared = prepared.withColumn("_held", literals.held(F.col("_low"), words))
            numbers = {word: i for i, word in enumerate(words)}
            any_of = lambda _, clause: literals.holds_any("_held", numbers, clause)
        else:
            shared = R.shared_clauses(searched)
            tests = [F.expr(R.contains_any("_low", c)).alias(name) for c, name in shared.items()]
            prepared = prepared.select("*", *tests)
    hits = [hit for rule in active for hit in _hits_sql(rule, compat, use_prefilter, shared, whole, any_of)]
    if not hits:
        hits = [_hit_struct("", "", "", 0, "CAST(map() AS map<string,string>)", "false")]
    # One column per rule, gathered in a step of its own: Spark compiles a wide projection in small
    # methods, does not merge steps that use a column twice, and moves no filter below the explode.
    names = [f"_r{i}" for i in range(len(hits))]
    kept = [c for c in logs.columns if c not in ("raw", "pid", "level", "message")]
    per_rule = prepared.select(
        *kept, F.left("message", F.lit(L.LIMITS["match_message"])).alias("message"),
        *[F.expr(hit).alias(name) for hit, name in zip(hits, names)],
    )
    gathered = per_rule.select(
        *kept, "message",
        F.when(F.coalesce(*names).isNotNull(), F.array_compact(F.array(*names))).alias("_hits"),
    )
    found = gathered.select(
        *kept, "message", F.explode(F.when(F.size("_hits") > 0, F.col("_hits"))).alias("_hit")
    )
    groups = F.transform_values("_hit.captured", lambda _, v: F.nullif(v, F.lit("")))
    own = F.map_filter("extracted", lambda _, v: v != "")
    captured = F.when(F.col("_hit.type") == "sequence", groups).otherwise(F.map_concat(groups, own))
    return found.select(
        "job_id", "host", "_hit.rule_path", "_hit.rule_id", "_hit.type", "_hit.pattern_idx",
        "ts", "ts_epoch", "timestamp", "hostname", "service", "message", "source_file", "line_no",
        captured.alias("captured"), F.lit(1).cast("bigint").alias("weight"),
    )


def _hits_sql(rule: Rule, compat: bool, use_prefilter: bool, shared: dict, whole: bool, any_of) -> list[str]:
    scoped = _scope_sql(rule, compat)

    def branch(i, pattern):
        found, captured = R.search("_text", pattern), R.capture("_text", pattern)
        if whole:
            captured = f"CASE WHEN {found} THEN {captured} ELSE {R.capture('_line', pattern)} END"
            found = f"({found} OR (_line IS NOT NULL AND {R.search('_line', pattern)}))"
        if use_prefilter:
            found = f"{R.prefilter('_low', pattern, shared, any_of)} AND {found}"
        return found, (rule.path, rule.id, rule.type, i, captured)

    if rule.type == "sequence":
        steps = [branch(i, p) for i, p in enumerate(rule.used_steps(compat))]
        return [_hit_struct(*values, f"{scoped} AND {found}") for found, values in steps]
    whens = " ".join(
        f"WHEN {found} THEN {_struct(*values)}"
        for found, values in (branch(i, p) for i, p in enumerate(rule.patterns))
    )
    return [f"CASE WHEN {scoped} THEN CASE {whens} END END"]


def _struct(path, rule_id, kind, index, captured) -> str:
    return (
        f"named_struct('rule_path', {sql_string(path)}, 'rule_id', {sql_string(rule_id)}, "
        f"'type', {sql_string(kind)}, 'pattern_idx', {index}, 'captured', {captured})"
    )


def _hit_struct(path, rule_id, kind, index, captured, condition) -> str:
    return f"CASE WHEN {condition} THEN {_struct(path, rule_id, kind, index, captured)} END"


def detect_pattern(logs: DataFrame, rules: RuleSet, **options) -> DataFrame:
    return search_rules(logs, rules, ("pattern",), **options)


# --------------------------------------------------------------------------- threshold (D4, D5)


def threshold_key(field: Column) -> Column:
    """The captured value; 'unknown' when nothing of that name was captured, NULL when it was empty."""
    return F.when(
        F.map_contains_key("captured", field), F.try_element_at("captured", field)
    ).otherwise(UNKNOWN_KEY)


def _keyed(hits: DataFrame, rules: RuleSet, compat: bool) -> DataFrame:
    spark = hits.sparkSession
    params = _params(
        spark,
        [(r.path, r.field, r.count, round(r.window_seconds * MICROS)) for r in rules.active("threshold")],
        "rule_path string, _field string, _n int, _w bigint",
    )
    micros = F.unix_micros("ts")
    if compat:
        micros = F.coalesce(micros, F.lit(0))
    # A plain string stands for the key, '' for a NULL one, so that joins on it are ordinary.
    return (
        hits.filter(F.col("type") == "threshold")
        .join(F.broadcast(params), "rule_path")
        .withColumn("key", threshold_key(F.col("_field")))
        .withColumn("_k", F.coalesce(F.concat(F.lit("="), F.col("key")), F.lit("")))
        .withColumn("_us", micros)
    )


def _params(spark: SparkSession, rows: list, ddl: str) -> DataFrame:
    """Rule settings as a table; the number of rules bounds it, so joins may broadcast it."""
    if len(rows) > MAX_RULES:
        raise ValueError(f"{len(rows)} rules exceed the limit of {MAX_RULES}")
    return spark.createDataFrame(rows, ddl).coalesce(1)


def fired_keys(
    hits: DataFrame, rules: RuleSet, keys: tuple = ("job_id",), *, compat: bool = False
) -> DataFrame:
    """(keys, rule_path, key): some N hits of the key lie within W seconds of each other.

    Hits are counted per cell, a small part of W; the counts combine before the shuffle. N hits in as
    many neighbouring cells as surely lie within W fire. If even the cells that a window can touch
    hold fewer, nothing can. Only where these two bounds leave it open are times fetched: for keys that
    nothing else has fired, in pairs of buckets that then hold a few times N hits at most.
    """
    return _fired(_keyed(hits, rules, compat), keys)[0]


def _fired(keyed: DataFrame, keys: tuple) -> tuple[DataFrame, bool]:
    """The keys that fire, and whether they may be many.

    Spark takes the size of a stored table's files for that of its rows, and does not count what an
    explode adds; it would gather hundreds of thousands of keys in the driver. Many keys are dealt instead.
    """
    group = [*keys, "rule_path", "_k"]
    dated = (
        keyed.filter(F.col("_us").isNotNull())
        .select(*group, "key", "_n", "_w", "_us", F.expr(f"greatest(1, (_w + {PARTS - 1}) div {PARTS})").alias("_width"))
        .withColumn("_cell", F.expr("(_us - pmod(_us, _width)) div _width"))
        .withColumn("_bucket", F.expr(f"(_cell - pmod(_cell, {PARTS})) div {PARTS}"))
    )
    about = [*group, "key", "_n", "_w", "_width", "_bucket"]
    counts = dated.groupBy(*about, "_cell").agg(F.count("*").alias("_hits"))
    # A window that ends in one bucket begins there or in the one before, so cells stand in two.
    near = counts.withColumn("_bucket", F.explode(F.array("_bucket", F.col("_bucket") + 1))).groupBy(*about).agg(
        F.sum("_hits").alias("_all"), F.collect_list(F.struct("_cell", "_hits")).alias("_cells")  # 2 * PARTS at most
    ).filter(F.col("_all") >= F.col("_n"))
    within = (
        "exists(filter(_cells, c -> c._cell >= _bucket * {parts}), c -> aggregate("
        "filter(_cells, x -> x._cell <= c._cell AND x._cell > c._cell - ({cells})), 0L, (sum, x) -> sum + x._hits) >= _n)"
    )
    judged = near.select(
        *about,
        F.expr(within.format(parts=PARTS, cells="(_w + 1) div _width")).alias("_sure"),
        F.expr(within.format(parts=PARTS, cells="(_w + _width - 1) div _width + 1")).alias("_open"),
    ).filter("_open")
    # A row per key that fires, and one per bucket that is open; few, and asked three times.
    judged = stored(judged.select(*group, "key", "_sure", F.when(~F.col("_sure"), F.col("_bucket")).alias("_pair")).distinct())
    many = judged.count() > FEW_KEYS
    sure = judged.filter("_sure").select(*group, "key")
    left = judged.filter("NOT _sure").join(_dealt(sure, many), group, "left_anti")
    if left.isEmpty():
        return sure, many
    pairs = _dealt(left.select(*group, "_pair", F.explode(F.array("_pair", F.col("_pair") - 1)).alias("_bucket")), many)
    straddling = (
        dated.join(pairs, [*group, "_bucket"])
        .groupBy(*group, "key", "_n", "_w", "_pair")
        .agg(F.sort_array(F.collect_list("_us")).alias("_times"))
        .filter(
            F.expr(
                "size(_times) >= _n AND exists(sequence(0, size(_times) - _n), "
                "i -> _times[i + _n - 1] - _times[i] <= _w)"
            )
        )
        .select(*group, "key")
    )
    return sure.unionByName(straddling).distinct(), many


def _dealt(df: DataFrame, many: bool) -> DataFrame:
    return df.hint("merge") if many else df


def detect_threshold(
    hits: DataFrame, rules: RuleSet, keys: tuple = ("job_id",), *, compat: bool = False
) -> DataFrame:
    """All hits, dated or not, of the keys that fire. ``hits`` comes from ``search_rules``."""
    keyed = _keyed(hits, rules, compat)
    # The hits of one key are dealt over several tasks, to each of which its row is repeated.
    part = F.pmod(F.xxhash64("source_file", "line_no"), F.lit(SALTS)).cast("int")
    group = [*keys, "rule_path", "_k", "_part"]
    fired, many = _fired(keyed, keys)
    fired = fired.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select(*group)
    return keyed.withColumn("_part", part).join(_dealt(fired, many), group, "left_semi").select(*hits.columns)


# --------------------------------------------------------------------------- sequence (D6)


def sequence_weights(
    hits: DataFrame, rules: RuleSet, keys: tuple = ("job_id",), *, key: str | None = None,
    compat: bool = False,
) -> DataFrame:
    """Each distinct time and step of a rule: ``hits`` there, and how many ``sequences`` each is part of.

    A sequence is one hit per step, each at most W after the one before and not earlier. Sequences
    are never built. Hits are first counted per distinct time; then each pass adds, for every time, what
    lies in the window before it and in the one after it. Two steps take one pass, k steps k - 1: the
    number of beginnings that end at a time feeds the next step, and completions go the other way.
    Numbers beyond 2^63 - 1 are given as that. Columns: keys, rule_path, _k, _us, step, hits, sequences.
    """
    steps = _steps(hits, rules, key, compat)
    lengths = {r.path: len(r.used_steps(compat)) for r in rules.active("sequence")}
    longer = {path: n for path, n in lengths.items() if n > 2}
    group = [*keys, "rule_path", "_k"]
    if not longer:
        return _of_two(steps, group)
    long = F.col("rule_path").isin(list(longer))
    out = _of_many(steps.filter(long), group, longer)
    return out if len(longer) == len(lengths) else _of_two(steps.filter(~long), group).unionByName(out)


def _steps(hits: DataFrame, rules: RuleSet, key: str | None, compat: bool) -> DataFrame:
    params = _params(
        hits.sparkSession,
        [(r.path, round(r.within_seconds * MICROS)) for r in rules.active("sequence")],
        "rule_path string, _w bigint",
    )
    micros = F.unix_micros("ts")
    if compat:
        micros = F.coalesce(micros, F.lit(0))
    entity = F.lit("") if key is None else F.coalesce(
        F.concat(F.lit("="), threshold_key(F.lit(key))), F.lit("")
    )
    return (
        hits.filter(F.col("type") == "sequence")
        .join(F.broadcast(params), "rule_path")
        .select("*", entity.alias("_k"), micros.alias("_us"))
        .filter(F.col("_us").isNotNull())
    )


def _of_two(steps: DataFrame, group: list) -> DataFrame:
    times = steps.groupBy(*group, "_w", "_us").agg(
        F.count_if(F.col("pattern_idx") == 0).alias("_n1"),
        F.count_if(F.col("pattern_idx") == 1).alias("_n2"),
    )
    found = _neighbours(times.select("*", (F.col("_n1") > 0).alias("_next"), (F.col("_n2") > 0).alias("_back")), group)
    both = F.array(
        F.struct(F.lit(0).alias("step"), F.col("_n1").alias("hits"), F.col("_after").alias("sequences")),
        F.struct(F.lit(1).alias("step"), F.col("_n2").alias("hits"), F.col("_before").alias("sequences")),
    )
    return found.select(*group, "_us", F.inline(both)).filter((F.col("hits") > 0) & (F.col("sequences") > 0))


def _of_many(steps: DataFrame, group: list, lengths: dict[str, int]) -> DataFrame:
    """Passes over all longer rules at once; each pass is a written table, so no plan doubles.

    ``_f[i]`` is the number of beginnings that end with one hit of step i at this time, ``_b[i]`` that
    of completions which start with it. Pass j finds ``_f[j]``, and ``_b`` of the j-th step from the end.
    """
    whole = "decimal(38,0)"
    most = F.lit(2**63 - 1).cast(whole)  # the product of two still fits
    size, zero, one = max(lengths.values()), F.lit(0).cast(whole), F.lit(1).cast(whole)
    length = F.create_map(*[F.lit(x) for item in sorted(lengths.items()) for x in item])[F.col("rule_path")]
    times = steps.groupBy(*group, "_w", "_us").agg(
        F.array(*[F.count_if(F.col("pattern_idx") == i).cast(whole) for i in range(size)]).alias("_n")
    )
    places = F.sequence(F.lit(0), F.lit(size - 1))
    times = times.select(
        "*", length.alias("_size"),
        F.transform(places, lambda i: F.when(i == 0, one).otherwise(zero)).alias("_f"),
        F.transform(places, lambda i: F.when(i == length - 1, one).otherwise(zero)).alias("_b"),
    )

    def product(numbers, i):
        return F.least(F.col("_n")[i] * F.col(numbers)[i], most).cast(whole)

    for j in range(1, size):
        step, back = F.lit(j), F.col("_size") - 1 - j
        times = times.select(
            "*", back.alias("_at"),
            F.when(step < F.col("_size"), product("_f", step - 1)).otherwise(zero).alias("_n1"),
            F.when(back >= 0, product("_b", F.greatest(back + 1, F.lit(0)))).otherwise(zero).alias("_n2"),
            ((back >= 0) & (F.get("_n", back) > 0)).alias("_next"), ((step < F.col("_size")) & (F.get("_n", step) > 0)).alias("_back"),
        )
        found = _neighbours(times, group, ("_w", "_size", "_n", "_f", "_b", "_at", "_next", "_back"))
        put = lambda old, here, at, new: F.when(
            F.col(here), F.transform(F.col(old), lambda x, i: F.when(i == at, F.least(F.col(new), most).cast(whole)).otherwise(x))
        ).otherwise(F.col(old))
        times = stored(found.select(
            *group, "_us", "_w", "_size", "_n",
            put("_f", "_back", step, "_before").alias("_f"), put("_b", "_next", F.col("_at"), "_after").alias("_b"),
        ))
    each = F.transform(places, lambda i: F.struct(
        i.alias("step"), F.col("_n")[i].cast("bigint").alias("hits"),
        F.least(F.col("_f")[i] * F.col("_b")[i], most).cast("bigint").alias("sequences"),
    ))
    return times.select(*group, "_us", F.inline(each)).filter((F.col("hits") > 0) & (F.col("sequences") > 0))


def _neighbours(times: DataFrame, group: list, carried: tuple = ()) -> DataFrame:
    """Each time with the sum of ``_n1`` over the window before it and of ``_n2`` over that after it.

    ``times`` has one row per group and ``_us``, with the window ``_w`` and whether a time wants
    what comes next (``_next``) or came before (``_back``). In buckets of length W the sum is a running
    one at t in its own bucket and one at t -+ W in the neighbour; buckets are split into cells, so
    a crowded moment spreads over many tasks. Gives group, _us, _n1, _n2, _before, _after, carried.
    """
    # Each time looks at itself and at the two ends of its window.
    kinds = "array(named_struct('kind', 'own', 'at', _us)"
    kinds += ", CASE WHEN _w > 0 AND _next THEN named_struct('kind', 'end', 'at', _us + _w) END"
    kinds += ", CASE WHEN _w > 0 AND _back THEN named_struct('kind', 'start', 'at', _us - _w) END)"
    own = F.col("_kind") == "own"
    points = (
        times.select("*", F.struct(*carried).alias("_carried") if carried else F.lit(None).alias("_carried"),
                     F.explode(F.expr(f"array_compact({kinds})")).alias("_p"))
        .select(
            *group, "_w", "_us", "_n1", "_n2", "_carried",
            F.col("_p.kind").alias("_kind"), F.col("_p.at").alias("_at"),
        )
        .select(
            *group, "_us", "_kind", "_at",
            *[F.when(own, F.col(n)).otherwise(0).cast(times.schema[n].dataType).alias(n) for n in ("_n1", "_n2")],
            *([F.when(own, F.col("_carried")).alias("_carried")] if carried else []),
            F.expr("CASE WHEN _w = 0 THEN _at ELSE (_at - pmod(_at, _w)) div _w END").alias("_bucket"),
            F.expr(
                f"CASE WHEN _w = 0 THEN 0 ELSE CAST(floor(pmod(_at, _w) / (_w / {CELLS}.0D)) AS int) END"
            ).alias("_cell"),
        )
    )
    by_cell = Window.partitionBy(*group, "_bucket").orderBy("_cell")
    cells = (
        points.groupBy(*group, "_bucket", "_cell")
        .agg(F.sum("_n1").alias("_c1"), F.sum("_n2").alias("_c2"))
        .select(
            *group, "_bucket", "_cell",
            *[
                F.coalesce(
                    F.sum(f"_c{i}").over(by_cell.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
                ).alias(f"_prev{i}")
                for i in (1, 2)
            ],
            *[
                F.sum(f"_c{i}").over(Window.partitionBy(*group, "_bucket")).alias(f"_all{i}")
                for i in (1, 2)
            ],
        )
    )
    by_time = Window.partitionBy(*group, "_bucket", "_cell").orderBy("_at")
    upto = by_time.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = by_time.rangeBetween(Window.unboundedPreceding, -1)
    placed = points.select(
        "*",
        F.sum("_n1").over(upto).alias("_upto1"),
        F.sum("_n2").over(upto).alias("_upto2"),
        F.coalesce(F.sum("_n1").over(before), F.lit(0)).alias("_before1"),
        F.coalesce(F.sum("_n2").over(before), F.lit(0)).alias("_before2"),
    ).join(cells, [*group, "_bucket", "_cell"])
    rest2 = F.col("_all2") - F.col("_prev2") - F.col("_before2")
    rest1 = F.col("_all1") - F.col("_prev1") - F.col("_before1")
    sum1 = F.col("_prev1") + F.col("_upto1")
    sum2 = F.col("_prev2") + F.col("_upto2")
    followers = F.when(F.col("_kind") == "own", rest2).when(F.col("_kind") == "end", sum2)
    leaders = F.when(F.col("_kind") == "own", sum1).when(F.col("_kind") == "start", rest1)
    out = placed.groupBy(*group, "_us").agg(
        F.sum("_n1").alias("_n1"),
        F.sum("_n2").alias("_n2"),
        F.sum(leaders).alias("_before"),
        F.sum(followers).alias("_after"),
        *([F.first("_carried", ignorenulls=True).alias("_carried")] if carried else []),
    )
    return out.select(*group, "_us", "_n1", "_n2", "_before", "_after", *(["_carried.*"] if carried else []))


def sequence_pairs(
    hits: DataFrame, rules: RuleSet, keys: tuple = ("job_id",), *, key: str | None = None,
    compat: bool = False,
) -> DataFrame:
    """Number of sequences per rule, under the name ``pairs``: (step 1, step 2) pairs if it has two steps.

    The number of steps times that is the finding's match count.
    """
    weights = sequence_weights(hits, rules, keys, key=key, compat=compat)
    total = F.try_sum(F.col("hits").cast("decimal(38,0)") * F.col("sequences"))
    return (
        weights.filter("step = 0").groupBy(*keys, "rule_path")
        .agg(F.least(total, F.lit(2**63 - 1).cast("decimal(38,0)")).cast("bigint").alias("pairs"))
        .filter(F.col("pairs") > 0)
    )


def detect_sequence(
    hits: DataFrame, rules: RuleSet, keys: tuple = ("job_id",), *, key: str | None = None,
    compat: bool = False,
) -> DataFrame:
    """Hits that take part in a sequence; ``weight`` is in how many.

    Without ``key`` any step 1 goes with any step 2 of the same rule, and so on; with it (say
    'src_ip') all must have captured the same value.
    """
    group = [*keys, "rule_path", "_k"]
    steps = _steps(hits, rules, key, compat)
    weights = sequence_weights(hits, rules, keys, key=key, compat=compat)
    return (
        steps.drop("weight")
        .join(weights.select(*group, "_us", F.col("step").alias("pattern_idx"), F.col("sequences").alias("weight")),
              [*group, "_us", "pattern_idx"])
        .select(*hits.columns)
    )


def detect(
    hits: DataFrame, rules: RuleSet, keys: tuple = ("job_id",), *, sequence_key: str | None = None,
    compat: bool = False,
) -> DataFrame:
    """Matches of all rules, from the stored result of ``search_rules``."""
    parts = [hits.filter(F.col("type") == "pattern")]
    if rules.active("threshold"):
        parts.append(detect_threshold(hits, rules, keys, compat=compat))
    if rules.active("sequence"):
        parts.append(detect_sequence(hits, rules, keys, key=sequence_key, compat=compat))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out



"""Personal data by candidate gradient boosting, in DataFrame operations and Spark's own boosted trees.

Base patterns give spans that always stay. High-recall generators propose wider, overlapping spans: spelled-out
addresses and runs of digits in any notation. Boosted trees score them by format and context; a threshold calibrated on
documents the trees have not seen selects those to add.

Nothing is labelled, so the trees learn from the corpus itself. Positive are the base matches that pass their check,
rewritten as they might be hidden (no plus, no country code, other separators) and described without what their pattern
is known by (the sign, the spelling of "at" and "dot"). All other wide candidates are unlabelled: a first fit takes them
as negative, those it rather takes for positive are set aside, and a second fit learns from the rest. So a form
of hiding is found where hidden data are not far more frequent than plain data of their kind.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm.common import written

# The base patterns, in the order in which kinds are listed. Possessive loops and look-behind only keep
# the matcher linear: a match that fails at the start of a run fails at every later place in it.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_NAME, _LABEL = r"[^\s@,;:<>()\[\]{}\"']", "[A-Za-z0-9-]++"
_AT, _DOT = r" ?[(\[{] ?(?i:at) ?[)\]}] ?", r" ?[(\[{] ?(?i:dot) ?[)\]}] ?"
WIDE = {
    "address": rf"(?<!{_NAME}){_NAME}++(?:(?:{_AT}| ?@ ?){_LABEL}(?:(?:{_DOT}| (?i:dot) | ?\. ?){_LABEL})*+| (?i:at) {_LABEL}(?:(?:{_DOT}| (?i:dot) ){_LABEL})++)",
    "number": r"[+(]?[0-9](?:[ ().:/_-]{0,2}[0-9])++",
}
KINDS = (*BASE, *WIDE)
LEAST_DIGITS = 7  # of a wide number
FEATURES = ("n_chars", "n_digits", "n_letters", "n_dots", "n_gaps", "n_groups", "first_group", "last_group", "longest_run", "bracketed", "luhn", "octets", "is_address", "n_local", "n_labels", "n_top", "well_formed",
            "named", "glued_before", "glued_after")
CONTEXT = r"(?i)(mail|contact|write|reach|phone|call|tel|fax|mobile|cell|card|visa|account|iban|addr|\bip\b)[^a-z]{0,6}$"
NAMING = "contact: "
LEAST_POSITIVE = 20
FAVOUR = 10.0  # weight of the positives in the first fit, so that hidden data among the unlabelled do not count against them
# How a match may be hidden, by kind, as SQL over `hit`; of addresses only plainer ones, as their signs are no feature.
HIDDEN = {
    "email": ["hit", "regexp_replace(hit, '[0-9]', '')", "concat(substring_index(hit, '@', 1), '@', substring_index(substring_index(hit, '@', -1), '.', -2))",
              "concat(coalesce(nullif(regexp_replace(substring_index(hit, '@', 1), '[^A-Za-z]', ''), ''), 'a'), '@', substring_index(substring_index(hit, '@', -1), '.', -2))"],
    "phone": ["substring(hit, 2)", "regexp_replace(hit, '^[+][0-9]{1,3}[ .-]*', '')", "regexp_replace(regexp_replace(hit, '^[+][0-9]{1,3}[ .-]*', ''), '[ ().-]+', '-')",
              "regexp_replace(regexp_replace(hit, '^[+][0-9]{1,3}[ .-]*', ''), '[ ().-]+', ' ')", "regexp_replace(substring(hit, 2), '[ ().-]+', '.')"],
    "card": ["regexp_replace(number, '([0-9]{4})(?=[0-9])', '$1.')", "regexp_replace(number, '([0-9]{4})(?=[0-9])', '$1  ')", "regexp_replace(number, '([0-9]{4})(?=[0-9])', '$1/')"],
    "ip": ["replace(hit, '.', ' . ')", "replace(hit, '.', '. ')", "replace(hit, '.', ':')"],
}


def _luhn(digits: Column | str) -> Column:
    """Luhn's check of a string of digits."""
    return F.expr(f"""aggregate(sequence(1, length({digits})), 0, (a, i) -> a + CASE
        WHEN i % 2 = 1 THEN cast(substring({digits}, -i, 1) AS int)
        WHEN substring({digits}, -i, 1) >= '5' THEN 2 * cast(substring({digits}, -i, 1) AS int) - 9
        ELSE 2 * cast(substring({digits}, -i, 1) AS int) END) % 10 = 0""")


def _octets(hit: str) -> Column:
    """Four dotted numbers of at most 255."""
    return F.expr(f"""size(split({hit}, '[.]')) = 4 AND forall(split({hit}, '[.]'), p -> length(p) > 0 AND p RLIKE '^[0-9]+$'
        AND length(trim(LEADING '0' FROM p)) <= 3 AND coalesce(try_cast(trim(LEADING '0' FROM p) AS int), 0) <= 255)""")


def candidates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a candidate, and one with null kind for a text without any: row, key, text_hash, kind, start, end, hit, number, before, after, valid."""
    text_col = F.coalesce(F.col(text), F.lit(""))
    base = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.xxhash64(text_col).alias("text_hash"), text_col.alias("text"))
    base = base.withColumn("digits", F.col("text").rlike("[0-9]")).withColumn("ats", F.col("text").rlike(r"@|[(\[{] ?(?i:at) ?[)\]}]") | (F.contains(F.lower("text"), F.lit(" at ")) & F.contains(F.lower("text"), F.lit("dot"))))
    need = {"email": "ats", "address": "ats", "phone": "digits AND instr(text, '+') > 0"}
    step = base
    for kind, pattern in {**BASE, **WIDE}.items():
        guard = F.expr(need.get(kind, "digits"))
        step = step.withColumn(f"h_{kind}", F.when(guard, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
        step = step.withColumn(f"p_{kind}", F.when(F.size(f"h_{kind}") > 0, F.split("text", pattern, -1)))
    lists = [F.coalesce(F.expr(f"transform(h_{k}, (h, i) -> struct('{k}' AS kind, i AS nth, h AS hit, length(p_{k}[i]) AS gap, right(p_{k}[i], 24) AS before, left(p_{k}[i + 1], 2) AS after))"),
                        F.array().cast("array<struct<kind:string,nth:int,hit:string,gap:int,before:string,after:string>>")) for k in KINDS]
    rows = written(step.select("row", "key", "text_hash", F.concat(*lists).alias("found")), "pii-candidates")
    each = rows.select("row", "key", "text_hash", F.explode_outer("found").alias("c")).select("row", "key", "text_hash", "c.*")
    order = Window.partitionBy("row", "kind").orderBy("nth")
    each = (each.withColumn("start", (F.sum("gap").over(order) + F.coalesce(F.sum(F.length("hit")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("long"))
            .withColumn("end", F.col("start") + F.length("hit")).withColumn("number", F.regexp_replace("hit", "[^0-9]", "")))
    n = F.length("number")
    valid = (F.when(F.col("kind") == "email", F.lit(True)).when(F.col("kind") == "ip", F.when(F.instr("hit", ".") > 0, _octets("hit")).otherwise(False))
             .when(F.col("kind") == "card", n.between(13, 19) & _luhn("number")).when(F.col("kind") == "phone", n.between(9, 15)).otherwise(False))
    return each.select("row", "key", "text_hash", "kind", "start", "end", "hit", "number", "before", "after", valid.alias("valid"))


def featured(df: DataFrame) -> DataFrame:
    """df with `features`, of the columns hit, before and after alone."""
    plain = F.regexp_replace(F.regexp_replace("hit", rf"{_AT}| (?i:at) | ?@ ?", "@"), rf"{_DOT}| (?i:dot) | ?\. ?", ".")
    step = df.withColumn("number", F.regexp_replace("hit", "[^0-9]", "")).withColumn("plain", F.lower(plain)).withColumn("is_address", F.contains("plain", F.lit("@")))
    step = step.withColumn("groups", F.expr("filter(split(hit, '[^0-9]+'), g -> g <> '')")).withColumn("local", F.substring_index("plain", "@", 1)).withColumn("labels", F.split(F.substring_index("plain", "@", -1), "[.]"))
    step = step.withColumn("quad", F.regexp_replace("hit", "[ .:]+", "."))
    n, top = F.length("number"), F.col("labels")[F.size("labels") - 1]

    def group(at: Column) -> Column:
        return F.when(F.size("groups") > 0, F.length(F.get("groups", at))).otherwise(0)

    values = {
        "n_chars": F.length("plain"), "n_digits": n, "n_letters": F.length(F.regexp_replace("plain", r"[^\p{L}]", "")), "n_dots": F.length("plain") - F.length(F.replace("plain", F.lit("."), F.lit(""))),
        "n_gaps": F.when(F.col("is_address"), 0).otherwise(F.length(F.regexp_replace("hit", r"[^ ()/_-]", ""))), "n_groups": F.size("groups"), "first_group": group(F.lit(0)), "last_group": group(F.size("groups") - 1),
        "longest_run": F.coalesce(F.array_max(F.transform("groups", lambda g: F.length(g))), F.lit(0)), "bracketed": F.contains("hit", F.lit("(")) & ~F.col("is_address"),
        "luhn": n.between(13, 19) & _luhn("number"), "octets": F.when(F.contains("quad", F.lit(".")), _octets("quad")).otherwise(False), "is_address": F.col("is_address"),
        "n_local": F.when(F.col("is_address"), F.length("local")).otherwise(0), "n_labels": F.when(F.col("is_address"), F.size("labels")).otherwise(0),
        "n_top": F.when(F.col("is_address") & top.rlike("^[a-z]+$"), F.length(top)).otherwise(0),
        "well_formed": F.col("is_address") & F.col("plain").rlike(r"^[a-z0-9._%+-]+@[a-z0-9-]+(\.[a-z0-9-]+)+$"),
        "named": F.col("before").rlike(CONTEXT), "glued_before": F.col("before").rlike(r"[\p{L}0-9]$"), "glued_after": F.col("after").rlike(r"^[\p{L}0-9]"),
    }
    step = step.withColumns({f"f_{k}": F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in values.items()})
    columns = [c for c in df.columns if c != "number"]
    return VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features").transform(step).select(*columns, "features")


def _chance(model: GBTClassificationModel, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("chance", vector_to_array("probability")[1])


def _weighed(df: DataFrame, positive: float) -> DataFrame:
    """df with `weight`: in each form, positive rows weigh `positive` times as much as the unlabelled ones together; a row stands for `times` candidates."""
    sums = df.groupBy("form").agg(F.sum(F.col("label") * F.col("times")).alias("p"), F.sum((1 - F.col("label")) * F.col("times")).alias("u"))
    return df.join(F.broadcast(sums), "form").withColumn("weight", F.col("times") * F.when(F.col("label") == 0, 1.0).otherwise(F.greatest("u", F.lit(1.0)) * positive / F.col("p"))).drop("p", "u")


def _steps(df: DataFrame) -> dict[str, list[tuple[int, float, float]]]:
    """form -> (hundredth of the chance, weight, weight of positive rows), highest first."""
    found: dict[str, list[tuple[int, float, float]]] = {}
    table = df.groupBy("form", F.floor(F.col("chance") * 100).cast("int").alias("step")).agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("good")).collect()
    for r in sorted(table, key=lambda r: -r["step"]):
        found.setdefault(r["form"], []).append((r["step"], r["n"], r["good"]))
    return found


def _by_form(values: dict[str, float]) -> Column:
    """The value of a row's form; what no chance reaches where it has none."""
    found = F.lit(1.01)
    for form, value in values.items():
        found = F.when(F.col("form") == form, value).otherwise(found)
    return found


def _learnt(base: DataFrame, wide: DataFrame, trees: int, depth: int, precision: float) -> tuple[GBTClassificationModel, dict[str, float]] | None:
    """The trees and by form (address, number) the chance from which a candidate is chosen; None where too few base matches teach them."""
    hidden = F.expr("CASE " + " ".join(f"WHEN kind = '{k}' THEN array({', '.join(v)})" for k, v in HIDDEN.items()) + " END")
    # Each once as it stands and once after a word that names such data, so that context counts for a candidate, never against it.
    form = F.when(F.col("kind") == "email", "address").otherwise("number").alias("form")
    known = (base.select("text_hash", "start", "end", form, F.explode(hidden).alias("hit"), "before", "after", F.lit(1.0).alias("label"))
             .select("text_hash", "start", "end", "form", "hit", F.explode(F.array("before", F.lit(NAMING))).alias("before"), "after", "label"))
    free = wide.select("text_hash", "start", "end", F.col("kind").alias("form"), "hit", "before", "after", F.lit(0.0).alias("label"))
    if not known.limit(1).count() or not free.limit(1).count():
        return None
    # Documents, not candidates, are dealt to the part that is fitted on and the part that is held back. What looks alike
    # to the trees is counted, so that all candidates teach them.
    held = (F.pmod(F.xxhash64("text_hash", F.lit(3)), F.lit(3)) == 0).alias("held")
    counted = featured(known.unionByName(free)).select("form", "label", held, vector_to_array("features").alias("values")).groupBy("form", "label", "held", "values").agg(F.count("*").alias("times"))
    sample = written(counted, "pii-sample").withColumn("features", array_to_vector("values")).drop("values")
    sizes = {(r["label"], r["held"]): r["n"] for r in sample.groupBy("label", "held").agg(F.sum("times").alias("n")).collect()}
    if sizes.get((1.0, False), 0) < LEAST_POSITIVE or not sizes.get((0.0, False)) or not sizes.get((1.0, True)):
        return None
    learner = GBTClassifier(maxIter=trees, maxDepth=depth, seed=10, maxMemoryInMB=64, weightCol="weight")
    first = learner.fit(_weighed(sample.where("NOT held"), FAVOUR).select("label", "features", "weight"))
    told = _chance(first, sample)
    # Where positives, favoured, prevail, unlabelled candidates are no reliable negatives.
    clear = written(_weighed(told.where((F.col("label") == 1) | (F.col("chance") < 0.5)).select("form", "label", "features", "held", "times"), 1.0), "pii-clear")
    if not clear.where("NOT held AND label = 0").limit(1).count():
        return None
    model = learner.fit(clear.where("NOT held").select("label", "features", "weight"))
    thresholds = {}
    for form_name, steps in _steps(_chance(model, clear.where("held"))).items():
        seen = good = 0.0
        for step, n, right in steps:
            seen, good = seen + n, good + right
            if good / seen >= precision and step >= 50:
                thresholds[form_name] = step / 100
    return model, thresholds


def find_pii(df: DataFrame, key: str = "doc_id", text: str = "text", trees: int = 8, depth: int = 4, precision: float = 0.98) -> DataFrame:
    """row, key, text_hash and spans (kind, start, end, base) of every row, by kind as listed and then start.

    - null and empty texts have no spans. Repeated rows each get their own, equal result.
    - added spans overlap no base span and no longer added span; base spans may overlap each other.
    - the trees and thresholds are learnt from every candidate of every text, all of which are scored. A corpus with
      too few base matches to learn from (LEAST_POSITIVE) gets base spans alone.
    - an empty table gives an empty result; other columns are ignored.
    """
    found = written(candidates(df, key, text), "pii-scored")
    valid = found.where(F.col("kind").isin(list(BASE)) & F.col("valid"))
    # A wide candidate overlaps a base span where one that starts no later ends after its start, or one starts within it.
    order = Window.partitionBy("row").orderBy("start")
    is_base = F.col("kind").isin(list(BASE))
    both = found.where((is_base & F.col("valid")) | (F.col("kind").isin(list(WIDE)) & ((F.col("kind") != "number") | (F.length("number") >= LEAST_DIGITS))))
    both = (both.withColumn("reach", F.max(F.when(is_base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1)))
            .withColumn("next", F.min(F.when(is_base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))))
    wide = both.where(~is_base & (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("end"))))
    wide = written(wide.select("row", "text_hash", "kind", "start", "end", "hit", "before", "after"), "pii-wide")
    kept = valid.select("row", "kind", "start", "end", F.lit(True).alias("base"))
    learnt = _learnt(valid, wide, trees, depth, precision)
    if learnt is not None:
        model, thresholds = learnt
        chosen = _chance(model, featured(wide).withColumn("form", F.col("kind"))).where(F.col("chance") >= _by_form(thresholds)).select("row", "kind", "start", "end")
        # Overlaps by a running maximum of ends within the text: the longest of each island of overlapping spans stays.
        by_start = Window.partitionBy("row").orderBy("start", F.desc("end"), "kind")
        island = chosen.withColumn("new", (F.col("start") >= F.coalesce(F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("int"))
        island = island.withColumn("island", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
        best = island.withColumn("nth", F.row_number().over(Window.partitionBy("row", "island").orderBy(F.desc(F.col("end") - F.col("start")), "start", "kind")))
        kept = kept.unionByName(best.where("nth = 1").select("row", "kind", "start", "end", F.lit(False).alias("base")))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    grouped = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "start", "end", "kind", "base"))).alias("spans"))
    every = found.groupBy("row").agg(F.first("key").alias("key"), F.first("text_hash").alias("text_hash"))
    empty = F.array().cast("array<struct<rank:bigint,start:bigint,end:bigint,kind:string,base:boolean>>")
    return every.join(grouped, "row", "left").select("row", "key", "text_hash", F.coalesce("spans", empty).alias("spans"))


def redact(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """df with every span replaced by its kind in brackets; overlapping spans become one, named after the first.

    Null texts stay null. Columns and rows of df stay as they are, whatever the columns' names.
    """
    spans = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    found = find_pii(df, key, text, **options).where(F.size("spans") > 0).select("key", "text_hash", spans.alias("spans")).dropDuplicates(["key", "text_hash"])
    # The row is one column here, so that no name of df can clash.
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"))
    own_key, own_text = F.col("doc").getField(key), F.col("doc").getField(text)
    joined = packed.join(found, own_key.eqNullSafe(F.col("key")) & (F.xxhash64(F.coalesce(own_text, F.lit(""))) == F.col("text_hash")), "left").withColumn("text", own_text)
    replaced = F.expr("""CASE WHEN spans IS NULL THEN text ELSE aggregate(spans, named_struct('at', 0L, 'out', ''),
        (a, s) -> named_struct('at', greatest(a.at, s.end), 'out', CASE WHEN s.start < a.at THEN a.out
            ELSE a.out || substring(text, cast(a.at + 1 AS int), cast(s.start - a.at AS int)) || '[' || upper(s.kind) || ']' END),
        a -> a.out || substring(text, cast(a.at + 1 AS int))) END""")
    return joined.select(*[(replaced if c == text else F.col("doc").getField(c)).alias(c) for c in df.columns])

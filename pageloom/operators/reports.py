"""Reports: metrics over labels as a whole, confusions, overlaps of splits, corrections by version, patterns of titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .labels import confusion_matrix, token_metrics

# Words that name a kind of dish in titles, and the words in which instructions begin.
KINDS = ["tea", "cocoa", "punch", "bread", "rolls"]
HOW_TO = "how to"


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))


def overall_metrics(words: DataFrame, outside: str = "O") -> DataFrame:
    """(scope, precision_, recall_, f1, support) over words (label, label_pred), rounded to 6 places: `micro` over the words whose
    true label isn't `outside` (a prediction of `outside` lowers recall alone), the `macro avg` and `weighted avg` of all labels
    that occur, and `accuracy` (in f1). Words with a null label on either side don't count. Without words each is 0."""
    c = F.col
    n = confusion_matrix(words.where(c("label").isNotNull() & c("label_pred").isNotNull()))
    inner, right = c("label") != outside, c("label") == c("label_pred")
    add = lambda x: F.coalesce(F.sum(F.when(x, c("n"))), F.lit(0))
    sums = n.agg(add(inner & right).alias("tp"), add(inner & (c("label_pred") != outside)).alias("predicted"), add(inner).alias("true"), add(right).alias("right"), add(F.lit(True)).alias("words"))
    p, r = _ratio(c("tp"), c("predicted")), _ratio(c("tp"), c("true"))
    micro = sums.select(F.lit("micro").alias("scope"), p.alias("p"), r.alias("r"), _f1(p, r).alias("f"), c("true").alias("support"))
    accuracy = _ratio(c("right"), c("words"))
    exact = sums.select(F.lit("accuracy").alias("scope"), accuracy.alias("p"), accuracy.alias("r"), accuracy.alias("f"), c("words").alias("support"))
    true = n.groupBy("label").agg(F.sum("n").alias("support"), add(right).alias("tp"))
    pred = n.groupBy(c("label_pred").alias("other")).agg(F.sum("n").alias("predicted"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    each = true.join(pred, c("label") == c("other"), "full").select(zero("support").alias("support"), _ratio(zero("tp"), zero("predicted")).alias("p"), _ratio(zero("tp"), zero("support")).alias("r"))
    each = each.withColumn("f", _f1(c("p"), c("r")))
    total = F.coalesce(F.sum("support"), F.lit(0))
    macro = each.agg(*(F.coalesce(F.avg(x), F.lit(0.0)).alias(x) for x in "prf"), total.alias("support")).select(F.lit("macro avg").alias("scope"), "p", "r", "f", "support")
    weighted = each.agg(*(_ratio(F.sum(c(x) * c("support")), F.sum("support")).alias(x) for x in "prf"), total.alias("support")).select(F.lit("weighted avg").alias("scope"), "p", "r", "f", "support")
    six = lambda x: F.round(x, 6)
    return micro.unionByName(macro).unionByName(weighted).unionByName(exact).select("scope", six("p").alias("precision_"), six("r").alias("recall_"), six("f").alias("f1"), "support")


def metrics_markdown(words: DataFrame, labels: list[str]) -> DataFrame:
    """(line_no, line): the report as markdown, with a line for each label that occurs, in the order of `labels`."""
    c = F.col
    three = lambda x: F.format_string("%.3f", c(x))
    place = lambda x: F.array_position(F.array(*map(F.lit, labels)), c(x)).cast("int")
    micro = overall_metrics(words).where("scope = 'micro'")
    head = micro.select(F.posexplode(F.array(
        F.lit("# Token classification report"), F.concat(F.lit("Precision: "), three("precision_")), F.concat(F.lit("Recall: "), three("recall_")),
        F.concat(F.lit("F1: "), three("f1")), F.lit(""), F.lit("## Per-label"),
    )).alias("line_no", "line"))
    row = F.concat(F.lit("- "), "label", F.lit(": P="), three("precision_"), F.lit(", R="), three("recall_"), F.lit(", F1="), three("f1"), F.lit(", support="), c("support").cast("string"))
    body = token_metrics(words).where(c("label").isin(labels)).select(F.lit(0).alias("at"), place("label").alias("place"), row.alias("line"))
    order = Window.partitionBy("at").orderBy("place")  # a row for each label
    return head.unionByName(body.select((F.row_number().over(order) + 5).alias("line_no"), "line"))


def confusion_csv(words: DataFrame, labels: list[str]) -> DataFrame:
    """(line_no, line): the confusion matrix over the labels that occur, as lines of CSV with the true labels in front."""
    c = F.col
    names = F.array(*map(F.lit, labels))
    n = confusion_matrix(words.where(c("label").isin(labels) & c("label_pred").isin(labels)))
    cells = n.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(",", "label", "label_pred"), "n"))).alias("m"), F.array_union(F.collect_set("label"), F.collect_set("label_pred")).alias("s"))
    held = cells.select("m", F.filter(names, lambda x: F.array_contains(c("s"), x)).alias("s"))  # a row; labels squared
    count = lambda a, b: F.coalesce(F.try_element_at("m", F.concat_ws(",", a, b)), F.lit(0)).cast("string")
    lines = F.transform("s", lambda a: F.concat_ws(",", a, F.transform("s", lambda b: count(a, b))))
    return held.where(F.size("s") > 0).select(F.posexplode(F.concat(F.array(F.concat(F.lit(","), F.array_join("s", ","))), lines)).alias("line_no", "line"))


def top_confusions(words: DataFrame, labels: list[str], most: int = 5) -> DataFrame:
    """(label, label_pred, n): the most frequent pairs of a true and another predicted label; of equals those first in `labels`."""
    place = lambda x: F.array_position(F.array(*map(F.lit, labels)), F.col(x))
    wrong = words.where((F.col("label") != F.col("label_pred")) & F.col("label").isin(labels) & F.col("label_pred").isin(labels))
    return confusion_matrix(wrong).orderBy(F.desc("n"), place("label"), place("label_pred")).limit(most)


def split_overlaps(splits: DataFrame) -> DataFrame:
    """(page_num, splits): the pages of splits (page_num, split) that are in more than one, with their splits by name."""
    each = splits.groupBy("page_num").agg(F.array_sort(F.collect_set("split")).alias("splits"))
    return each.where(F.size("splits") > 1)


def check_splits(splits: DataFrame, wanted: list[str]) -> DataFrame:
    """One row on splits: missing (those of wanted without pages), overlapping pages, rows, and ok: none missing or overlapping."""
    seen = splits.agg(F.collect_set("split").alias("seen"), F.count("*").alias("n"))
    missing = F.array_except(F.array(*map(F.lit, wanted)), "seen")
    shared = split_overlaps(splits).agg(F.count("*").alias("overlapping"))
    out = seen.join(F.broadcast(shared))  # a row and a row
    return out.select(F.array_join(F.array_sort(missing), ",").alias("missing"), "overlapping", "n", ((F.size(missing) == 0) & (F.col("overlapping") == 0)).alias("ok"))


def corrections_by_version(corrected: DataFrame, version: str = "version") -> DataFrame:
    """Of apply_corrections' rows, by the version of the model that made them: pages, corrected ones, those with any change and
    their rate, and how often each field was changed."""
    changed, n = F.count_if(F.size("changes") > 0), F.count("*")
    of = lambda field: F.count_if(F.array_contains("changes", field)).alias(f"{field}_changed")
    return corrected.groupBy(version).agg(n.alias("pages"), F.count_if("corrected").alias("corrected"), changed.alias("changed"), F.round(changed / n, 6).alias("rate"), of("title"), of("ingredients"), of("instructions"))


def header_statistics(words: DataFrame, label: str = "label_v3") -> DataFrame:
    """By page: words, those not O, their share, whether there are any, and words by newer label."""
    n = lambda x: F.count_if(F.col(label) == x)
    inner = F.count_if(F.col(label) != "O")
    return words.groupBy("page_num").agg(
        F.count("*").alias("tokens"), inner.alias("non_o"), (inner / F.count("*")).alias("non_o_ratio"), (inner > 0).alias("has_labels"), n("PAGE_HEADER").alias("page_header_count"),
        n("SECTION_HEADER").alias("section_header_count"), n("RECIPE_TITLE").alias("recipe_title_count"), n("INGREDIENT_LINE").alias("ingredient_count"), n("INSTRUCTION_STEP").alias("instruction_count"),
    )


def encode_pages(words: DataFrame, labels: list[str], unknown: str | None = None) -> DataFrame:
    """words with label_id, the place of the label in labels. An unknown label (null too) is that of `unknown`; without one, all
    words of its page go."""
    at = F.array_position(F.array(*map(F.lit, labels)), F.col("label")).cast("int")
    place = F.when(at > 0, at - 1)
    if unknown is not None:
        return words.withColumn("label_id", F.coalesce(place, F.lit(labels.index(unknown))))
    coded = words.withColumn("label_id", place)
    lost = coded.where("label_id is null").select("page_num").distinct()
    return coded.join(lost, "page_num", "left_anti")


def title_lengths(titles: DataFrame) -> DataFrame:
    """One row on titles (title, n_words): least, most, mean and most frequent number of words (of equals the least)."""
    n = titles.groupBy("n_words").agg(F.count("*").alias("n"))
    best = F.min_by("n_words", F.struct((-F.col("n")).alias("n"), "n_words"))
    return n.agg(F.min("n_words").alias("least"), F.max("n_words").alias("most"), F.round(F.sum(F.col("n_words") * F.col("n")) / F.sum("n"), 6).alias("mean"), best.alias("mode"))


def title_classes(titles: DataFrame) -> DataFrame:
    """titles (page_num, title) with pattern: `how to`, `described kind` (of several words, one of them of KINDS), `kind`, or none."""
    words = F.filter(F.split(F.lower("title"), r"\s+"), lambda x: x != "")
    kind = F.arrays_overlap(words, F.array(*map(F.lit, KINDS)))
    found = F.when(F.lower("title").startswith(HOW_TO), "how to").when((F.size(words) > 1) & kind, "described kind").when(kind, "kind").otherwise("none")
    return titles.select("page_num", "title", found.alias("pattern"))


def _title_words(titles: DataFrame) -> DataFrame:
    return titles.select(F.explode(F.split(F.lower("title"), r"\s+")).alias("word")).select(F.regexp_replace("word", r"\.+$", "").alias("word")).where("word <> ''")


def common_title_words(titles: DataFrame, most: int = 10) -> DataFrame:
    """(word, n): the most frequent words of titles, without case and without periods at their ends; of equals the first by name."""
    return _title_words(titles).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(most)


def heavy_title_words(titles: DataFrame, by: str, share: float = 0.01, tracked: int = 10_000) -> DataFrame:
    """(word, n): words that make up at least `share` of all title words, by sketches of heavy hitters that are kept for each value
    of `by` (a book, a day) and combined, so that a new one doesn't need the old ones' titles.

    A sketch tracks at most `tracked` words: counts are exact as long as no sketch has met 0.75 x tracked different ones; beyond
    that a word's count can be over by about 3.5 / tracked of all words. There are at most 1 / share such words, so none is lost."""
    words = titles.select(by, F.explode(F.split(F.lower("title"), r"\s+")).alias("word")).select(by, F.regexp_replace("word", r"\.+$", "").alias("word")).where("word <> ''")
    sketches = words.groupBy(by).agg(F.expr(f"approx_top_k_accumulate(word, {tracked})").alias("sketch"), F.count("*").alias("n"))
    whole = sketches.agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {tracked}), {int(1 / share) + 1})").alias("top"), F.sum("n").alias("total"))
    return whole.select(F.inline("top"), "total").where(F.col("count") >= share * F.col("total")).select(F.col("item").alias("word"), F.col("count").alias("n"))

"""Titles and section headers: runs of words scored by place, wording and what follows; title lines of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import text as T

# Words and limits that decide results.
FOOD = [
    "bread", "tea", "coffee", "cocoa", "chocolate", "punch", "soup", "cake", "pie", "cookies", "rolls", "muffins", "pudding", "sauce", "salad", "meat",
    "fish", "chicken", "beef", "pork", "egg", "omelet", "pancake", "waffle", "toast", "biscuit", "scone", "tart", "cream", "custard", "jelly", "jam",
    "syrup", "broth", "stew", "roast", "fried", "baked", "boiled", "steamed",
]
NOT_TITLES = ["boston", "cooking-school", "cook", "book", "chapter", "contents", "index", "page", "continued"]
CONNECTORS = ["AND", "MAKING", "THE", "FOR", "OF", "WITH", "TO", "IN", "ON"]
CONNECTORS_V1 = ["AND", "MAKING", "THE", "FOR", "OF", "WITH"]
STEP_STARTS = ["To", "Put", "Add", "Heat", "Cook", "Mix", "Stir", "Pour", "Follow", "Remove", "Place", "Serve"]
LEAST_V1, LEAST_V2, TITLE_TOKENS, SAME_LINE = 10, 12, 8, 12


def caps(word: Column) -> Column:
    """Not a word of letters alone, or one in capitals."""
    return ~word.rlike(r"^\p{L}+$") | (word.rlike(r"\p{Lu}") & ~word.rlike(r"\p{Ll}"))


def word_runs(words: DataFrame, lengths: tuple[int, int], key: str = "page_num") -> DataFrame:
    """(key, height, start, len, run, y_share) for each run of `lengths` words in a row: its words, and their mean top edge in
    percent of the page's height. A window of a few words ahead; no row meets more than that."""
    w = Window.partitionBy(key).orderBy("word_idx").rowsBetween(0, lengths[1] - 1)
    ahead = words.select(key, "height", F.col("word_idx").alias("start"), F.collect_list(F.struct("word", "y0")).over(w).alias("ahead"))
    some = F.sequence(F.lit(lengths[0]), F.size("ahead"))
    rows = ahead.where(F.size("ahead") >= lengths[0]).select(key, "height", "start", "ahead", F.explode(some).alias("len"))
    of = rows.withColumn("run", F.transform(F.slice("ahead", 1, F.col("len")), lambda x: x["word"]))
    total = F.aggregate(F.slice("ahead", 1, F.col("len")), F.lit(0).cast("bigint"), lambda a, x: a + x["y0"])
    return of.withColumn("y_share", total / F.col("len") / F.col("height") * 100).drop("ahead")


def detect_section_header(words: DataFrame, first: int = 50, top: float = 5.0) -> DataFrame:
    """(page_num, start, end, header): the first run of 2 to 6 words, the shorter before the longer, that begins in the first
    words of the page, lies in its top part, is in capitals and holds a connector. Pages without one have no row."""
    some = words.where(F.col("word_idx") < first + 5)
    fit = word_runs(some, (2, 6)).where((F.col("start") < first) & (F.col("y_share") <= top))
    found = fit.where(F.forall("run", caps) & F.arrays_overlap("run", F.array(*map(F.lit, CONNECTORS))))
    best = found.groupBy("page_num").agg(F.min_by(F.struct("start", "len", "run"), F.struct("start", "len")).alias("b"))
    return best.select("page_num", F.col("b.start").alias("start"), (F.col("b.start") + F.col("b.len")).alias("end"), F.array_join("b.run", " ").alias("header"))


def _foods(run: Column, marks: str) -> Column:
    bare = F.transform(run, lambda w: F.regexp_replace(F.lower(w), f"[{marks}]+$", ""))
    return F.size(F.filter(bare, lambda w: w.isin(FOOD)))


def _points(*rules: tuple[Column, Column | int]) -> Column:
    total = F.lit(0)
    for when, value in rules:
        total = total + F.when(when, value).otherwise(0)
    return total


def detect_title_v1(words: DataFrame) -> DataFrame:
    """(page_num, start, end, title, score): the best run of 2 to 5 words in the top 30 %. Runs below the top 5 % are preferred,
    then higher scores, then earlier and shorter runs. Pages without a run of LEAST_V1 points have no row.

    A page's words are gone through from its last to its first, so that frames only grow. Words behind the last one that lies high
    enough are left out before runs are made, and what rules ask of a word is looked up once for all its runs."""
    c, longest = F.col, 5
    upwards = Window.partitionBy("page_num").orderBy(F.desc("word_idx"))
    after, around = upwards.rowsBetween(Window.unboundedPreceding, -1), upwards.rowsBetween(Window.unboundedPreceding, longest - 1)
    high = c("y0") <= c("height") * 0.31  # more than 30 %, as means are rounded
    few = words.select("page_num", "height", "word_idx", "word", "y0", F.when(c("label") == "INGREDIENT_LINE", c("word_idx")).alias("ingredient"))
    some = few.withColumns({"next_ingredient": F.min("ingredient").over(after), "high": F.max(high).over(around)}).where("high")
    low = F.lower("word")
    facts = F.struct(
        "word", "y0", "next_ingredient", caps(c("word")).alias("caps"), c("word").isin(CONNECTORS_V1).alias("connects"), low.rlike("|".join(NOT_TITLES)).alias("barred"),
        F.regexp_replace(low, "[.,]+$", "").isin(FOOD).cast("int").alias("food"), c("word").endswith(".").alias("stops"),
    )
    known = some.select("page_num", "height", c("word_idx").alias("start"), facts.alias("w0"))
    upwards = Window.partitionBy("page_num").orderBy(F.desc("start"))
    nexts = known.withColumns({f"w{k}": F.lag("w0", k).over(upwards) for k in range(1, longest)})
    how = F.lower(F.concat_ws(" ", "w0.word", "w1.word")).startswith("how to")
    first = F.struct(how.alias("how"), c("w0.word").rlike(r"^\p{Lu}").alias("upper"), c("w0.word").rlike(r"^\d{1,3}$").alias("number"))
    ahead = nexts.where("w1 IS NOT NULL").select("page_num", "height", "start", first.alias("first"), F.array_compact(F.array(*(f"w{k}" for k in range(longest)))).alias("ahead"))
    rows = ahead.select("*", F.explode(F.sequence(F.lit(2), F.size("ahead"))).alias("len")).withColumn("run", F.slice("ahead", 1, c("len"))).drop("ahead")
    total = lambda k: F.aggregate("run", F.lit(0).cast("bigint"), lambda a, x: a + x[k])
    runs = rows.withColumns({"y_share": total("y0") / c("len") / c("height") * 100, "end": c("start") + c("len"), "last": F.element_at("run", -1)})
    runs = runs.where((c("y_share") <= 30) & ~F.exists("run", lambda x: x["barred"]))
    header = F.forall("run", lambda x: x["caps"]) & F.exists("run", lambda x: x["connects"])
    score = _points(
        (header, -10), (c("first.how"), 10), (F.lit(True), 5 * total("food")), (c("last.stops"), 3), (c("y_share") < 10, 5),
        (c("y_share").between(10, 20) & (c("y_share") < 20), 2), (c("len") <= 4, 2), (c("first.upper"), 1),
        (F.coalesce(c("last.next_ingredient") < c("end") + 50, F.lit(False)), 3), (c("first.number"), -5),
    )
    title = F.array_join(F.transform("run", lambda x: x["word"]), " ")
    order = F.struct((c("y_share") < 5).alias("at_top"), (-c("score")).alias("points"), "start", "len")
    best = runs.withColumn("score", score.cast("int")).where(c("score") >= LEAST_V1).groupBy("page_num").agg(F.min_by(F.struct("start", "end", title.alias("title"), "score"), order).alias("b"))
    return best.select("page_num", "b.*")


def _of_pages(rows: DataFrame) -> DataFrame:
    """A row or none for each page, looked up by the page's words: a task holds those of its pages and doesn't sort the words."""
    return rows.hint("shuffle_hash")


def detect_title_v2(words: DataFrame, headers: DataFrame) -> DataFrame:
    """(page_num, start, end, title, score): the best run of 2 to 5 words after the page's section header and before its first
    ingredient (else among the first 150 words), 5 to 30 % down, not in capitals; higher scores first, then earlier and shorter
    runs. Pages without a run of LEAST_V2 points have no row. headers are the rows of detect_section_header."""
    c = F.col
    known = words.groupBy("page_num").agg(F.count("*").alias("n"), F.nullif(F.min(F.when(c("label") == "INGREDIENT_LINE", c("word_idx"))), F.lit(0)).alias("ingredient"))
    bounds = known.join(headers.select("page_num", c("end").alias("header_end")), "page_num", "left")
    limits = bounds.select("*", F.coalesce("header_end", F.lit(0)).alias("since"), F.coalesce("ingredient", F.least("n", F.lit(150))).alias("upto"))
    some = words.join(_of_pages(limits), "page_num").where((c("word_idx") >= c("since")) & (c("word_idx") < c("upto")))
    runs = word_runs(some, (2, 5)).where("y_share between 5 and 30").withColumn("end", c("start") + c("len")).join(bounds, "page_num")
    runs = runs.where(~F.forall("run", caps)).withColumn("title", F.array_join("run", " "))
    score = _points(
        (F.lower("title").startswith("how to"), 15), (F.lit(True), 5 * _foods(c("run"), ".,;:")), (c("title").endswith("."), 3),
        (c("y_share") <= 15, 5), ((c("y_share") > 15) & (c("y_share") <= 20), 2), (c("len") <= 4, 3), (c("title").rlike(r"^\p{Lu}"), 1),
        (c("header_end").isNotNull(), 5), (F.coalesce(c("end") < c("ingredient"), F.lit(False)), 3),
    )
    order = F.struct((-c("score")).alias("points"), "start", "len")
    best = runs.withColumn("score", score).where(c("score") >= LEAST_V2).groupBy("page_num").agg(F.min_by(F.struct("start", "end", "title", "score"), order).alias("b"))
    return best.select("page_num", "b.*")


def apply_title_labels(words: DataFrame, headers: DataFrame, titles: DataFrame) -> DataFrame:
    """words with label_v3: RECIPE_TITLE on the words of the page's title, SECTION_HEADER on those of its header, else label."""
    c = F.col
    h = headers.select("page_num", c("start").alias("h_start"), c("end").alias("h_end"))
    t = titles.select("page_num", c("start").alias("t_start"), c("end").alias("t_end"))
    within = lambda p: (c("word_idx") >= c(f"{p}_start")) & (c("word_idx") < c(f"{p}_end"))
    both = words.join(_of_pages(h), "page_num", "left").join(_of_pages(t), "page_num", "left")
    return both.withColumn("label_v3", F.when(within("t"), "RECIPE_TITLE").when(within("h"), "SECTION_HEADER").otherwise(c("label"))).drop("h_start", "h_end", "t_start", "t_end")


def _title_row(rows: Column) -> list[Column]:
    """Text, number of tokens and box of title tokens, given from left to right."""
    joined = F.array_join(F.transform(rows, lambda x: x["word"]), " ")
    part = lambda f, k: f(F.transform(rows, lambda x: x[k]))
    boxes = [part(F.array_min, "x0").alias("tx0"), part(F.array_min, "y0").alias("ty0"), part(F.array_max, "x1").alias("tx1"), part(F.array_max, "y1").alias("ty1")]
    return [T.correct_title(T.clean_text(T.strip_quotes(joined))).alias("title"), F.size(rows).alias("n_tokens"), *boxes]


def extract_title_heuristic(words: DataFrame) -> DataFrame:
    """(page_num, title, n_tokens, box, conf 0.5): the first line of capitalised words near the top of a page that holds two or
    more and ends in a period, or reaches TITLE_TOKENS; else the last line that was begun there, if it has two.

    A fold over the page's candidates by (y0, x0): a word joins the line whose mean centre is within SAME_LINE pixels. Pages
    without such a line have no row.
    """
    c = F.col
    fit = c("y0").between(51, 399) & (F.char_length("word") > 1) & c("word").rlike(r"^[\p{Lu}(]") & ~c("word").isin(STEP_STARTS)
    token = F.struct("y0", "x0", "word_idx", "x1", "y1", "word", ((c("y0") + c("y1")) / 2).alias("mid"))
    pages = words.where(fit).groupBy("page_num").agg(F.sort_array(F.collect_list(token)).alias("all"))
    empty = F.slice("all", 1, 0)
    start = F.struct(empty.alias("line"), F.lit(0.0).alias("sum"), F.lit(False).alias("done"))
    dot = lambda x: F.rtrim(x["word"]).endswith(".")

    def step(s: Column, x: Column) -> Column:
        n = F.size(s["line"])
        joins = (n > 0) & (F.abs(x["mid"] - s["sum"] / F.greatest(n, F.lit(1))) <= SAME_LINE)
        more = F.struct(F.concat(s["line"], F.array(x)).alias("line"), (s["sum"] + x["mid"]).alias("sum"), (dot(x) | (n + 1 >= TITLE_TOKENS)).alias("done"))
        fresh = F.struct(F.array(x).alias("line"), x["mid"].cast("double").alias("sum"), F.lit(False).alias("done"))
        ends = (n >= 2) & F.exists(s["line"], dot)
        over = F.struct(s["line"].alias("line"), s["sum"].alias("sum"), F.lit(True).alias("done"))
        return F.when(s["done"], s).when(joins, more).when(ends, over).otherwise(fresh)

    found = pages.select("page_num", F.aggregate("all", start, step, lambda s: s["line"]).alias("line")).where(F.size("line") >= 2)
    by_x = F.array_sort(F.transform("line", lambda x: F.struct(x["x0"].alias("x0"), x["y0"].alias("y0"), x["word_idx"].alias("word_idx"), x["x1"].alias("x1"), x["y1"].alias("y1"), x["word"].alias("word"))))
    return found.select("page_num", *_title_row(by_x), F.lit(0.5).alias("conf"))


def extract_title(words: DataFrame, label: str = "RECIPE_TITLE") -> DataFrame:
    """(page_num, title, n_tokens, box, conf, by): the title that labels give (by "model"), or the heuristic one.

    Labelled tokens above y 350 count, on the line of the first of them (in word order), from left to right up to a period or
    TITLE_TOKENS. The heuristic stands in where there is no labelled token, none above y 350, or TITLE_TOKENS or more there;
    without a heuristic title the labelled tokens are taken all the same. conf is the mean confidence (0..1) of the tokens.
    """
    c = F.col
    labelled = words.where(c("label") == label).withColumns({"mid": (c("y0") + c("y1")) / 2, "upper": c("y0") < 350})
    page = Window.partitionBy("page_num")
    counted = labelled.withColumns({"n_upper": F.count_if("upper").over(page)}).where(c("upper") | (c("n_upper") == 0))
    line = counted.withColumn("first_mid", F.min_by("mid", "word_idx").over(page)).where(F.abs(c("mid") - c("first_mid")) <= SAME_LINE)
    order = Window.partitionBy("page_num").orderBy("x0", "word_idx")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = line.withColumns({"nth": F.row_number().over(order), "ended": F.coalesce(F.max(F.rtrim("word").endswith(".")).over(earlier), F.lit(False))})
    taken = upto.where(~c("ended") & (c("nth") <= TITLE_TOKENS))
    rows = F.sort_array(F.collect_list(F.struct("x0", "y0", "word_idx", "x1", "y1", "word")))
    grouped = taken.groupBy("page_num").agg(rows.alias("rows"), F.first("n_upper").alias("n_upper"), (F.avg("conf") / 100).alias("conf"))
    model = grouped.select("page_num", F.struct(*_title_row(c("rows")), "conf", F.lit("model").alias("by")).alias("m"), ((c("n_upper") == 0) | (c("n_upper") >= TITLE_TOKENS)).alias("doubtful"))
    h = extract_title_heuristic(words)
    other = h.select("page_num", F.struct(*[x for x in h.columns if x != "page_num"], F.lit("heuristic").alias("by")).alias("h"))
    both = model.join(other, "page_num", "full")
    pick = F.when(c("m").isNull() | (c("doubtful") & c("h").isNotNull()), c("h")).otherwise(c("m"))
    return both.select("page_num", pick.alias("p")).select("page_num", "p.*")

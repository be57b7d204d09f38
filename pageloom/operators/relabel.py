"""Labels by rule from place, wording and neighbours: titles told apart, mock labels, overrides, and simple label maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluation import near_ingredients, standalone_caps

# Phrases of page headers, words of section headers, and the words of the mock labeller.
HEADER_PHRASES = ["BOSTON", "COOKING", "SCHOOL", "COOK", "BOOK", "RECIPES", "INDEX", "CONTENTS", "TABLE"]
SECTION_WORDS = [
    "BISCUITS", "BREAKFAST", "CAKES", "BREADS", "SOUPS", "MEATS", "VEGETABLES", "DESSERTS", "SAUCES", "SALADS", "FISH", "POULTRY", "EGGS", "PIES", "PUDDINGS", "BEVERAGES",
]
MOCK_INGREDIENTS = ["cup", "cups", "tsp", "tbsp", "flour", "sugar", "salt", "butter", "milk", "eggs"]
MOCK_VERBS = ["mix", "stir", "bake", "add", "beat", "fold", "cook", "heat", "pour", "sift", "combine"]


def relabel_titles_v3(words: DataFrame, vocabulary: DataFrame, label: str = "TITLE") -> DataFrame:
    """words with label_v3: a title word becomes PAGE_HEADER, SECTION_HEADER or RECIPE_TITLE; other labels stay.

    The page header is the top tenth, and words that are common there (vocabulary, column header_word), hold a phrase, or are
    numbers. Between a tenth and a quarter, words in capitals are section headers if they hold a section word or no mixed-case
    word shares their line. Between 0.15 and 0.5 a word with ingredients below it is a recipe title. What is left is a recipe
    title with a lower-case letter or from 0.4 down, else a section header. The vocabulary has a row for each different word
    of page tops, so its join is left to the planner.
    """
    c = F.col
    share = (c("y0") + c("y1")) / 2 / c("height")
    upper = F.upper("word")
    titles = words.where(c("label") == label)
    near = near_ingredients(words, label=label).where("is_near").select("page_num", "word_idx", F.lit(True).alias("near"))
    alone = standalone_caps(words).select("page_num", "word_idx", F.lit(True).alias("alone"))
    known = vocabulary.select(c("header_word").alias("upper"), F.lit(True).alias("common")).distinct()
    facts = titles.withColumn("upper", upper).join(known, "upper", "left").join(near, ["page_num", "word_idx"], "left").join(alone, ["page_num", "word_idx"], "left")
    true = lambda name: F.coalesce(c(name), F.lit(False))
    header = (share < 0.10) | true("common") | c("upper").rlike("|".join(HEADER_PHRASES)) | c("word").rlike(r"^\d+$")
    section = (share > 0.10) & (share < 0.25) & (c("upper") == c("word")) & (F.char_length("word") > 3) & (c("upper").rlike("|".join(SECTION_WORDS)) | true("alone"))
    recipe = ((share > 0.15) & (share < 0.50) & true("near")) | c("word").rlike(r"\p{Ll}") | (share >= 0.40)
    new = F.when(header, "PAGE_HEADER").when(section, "SECTION_HEADER").when(recipe, "RECIPE_TITLE").otherwise("SECTION_HEADER")
    found = facts.select("page_num", "word_idx", new.alias("label_v3"))
    both = words.join(found, ["page_num", "word_idx"], "left")
    return both.withColumn("label_v3", F.coalesce("label_v3", "label"))


def mock_labels(words: DataFrame) -> DataFrame:
    """words with label_mock and conf_mock by place and wording alone: the labeller that stands in where there is no model.
    Any function from words to words with such columns can take its place."""
    c = F.col
    mid = (c("y0") + c("y1")) / 2
    title = (mid > 50) & (mid < 250) & c("word").rlike(r"^\p{Lu}") & (F.char_length("word") > 3) & c("word").rlike(r"\p{Ll}")
    amount = c("word").rlike(r"\p{Nd}") | F.lower("word").isin(MOCK_INGREDIENTS)
    verb = F.lower("word").isin(MOCK_VERBS)
    pick = lambda a, b, d, e: F.when(title, a).when(amount, b).when(verb, d).otherwise(e)
    return words.withColumns({"label_mock": pick("TITLE", "INGREDIENT_LINE", "INSTRUCTION_STEP", "O"), "conf_mock": pick(0.92, 0.88, 0.86, 0.85)})


def collapse_labels(words: DataFrame, label: str = "label", gone: str = "NOTE") -> DataFrame:
    """words with the label `gone` made O."""
    return words.withColumn(label, F.when(F.col(label) == gone, "O").otherwise(F.col(label)))


def override_labels(suggested: DataFrame, manual: DataFrame) -> DataFrame:
    """suggested (page_num, word_idx, label) with the labels that manual has for a word, and by (manual or suggested). Of several
    manual rows for a word the one with the greatest `at` counts."""
    last = manual.groupBy("page_num", "word_idx").agg(F.max_by("label", "at").alias("manual"))
    both = suggested.join(last, ["page_num", "word_idx"], "left")
    by = F.when(F.col("manual").isNotNull(), "manual").otherwise("suggested")
    return both.withColumns({"by": by, "label": F.coalesce("manual", "label")}).drop("manual")


def resolve_label_map(*sources: DataFrame) -> DataFrame:
    """(label_id, label) of the first of the sources, in order, that has rows."""
    tagged = [s.select("label_id", "label", F.lit(k).alias("tier")) for k, s in enumerate(sources)]
    every = tagged[0]
    for s in tagged[1:]:
        every = every.unionByName(s)
    first = every.agg(F.min("tier").alias("tier"))
    return every.join(F.broadcast(first), "tier").select("label_id", "label")  # one row


def label_column(df: DataFrame, names: tuple[str, ...] = ("labels", "ner_tags", "label_ids")) -> DataFrame:
    """df with its label column, the first of the names that it has, called labels; null where it has none."""
    found = next((n for n in names if n in df.columns), None)
    return df.withColumn("labels", F.col(found) if found else F.lit(None))

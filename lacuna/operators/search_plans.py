"""Search texts turned into phrases, fielded queries and facets: expressions and joins over a table of queries (qid, text).

What to say for a facet is a table of rules (facet, cues, added words, required words, whether categories are narrowed); a facet applies to a query if one
of its cues is among the query's words, or if it has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Words that are no phrases; the facets' labels, cues, added and required words; the categories of narrowed facets; operators of fielded queries.
STOPS = ("the", "and", "for", "with", "from", "this", "that", "are", "was", "has", "can", "its", "into", "via", "how", "why", "what", "does", "when", "where", "which", "not", "all", "any", "use", "using")
RULES = (
    ("core topic", (), (), (), False),
    ("robustness and sensitivity", ("robust", "robustness", "sensitivity", "perturbation", "instability", "failure", "brittle"), ("robustness", "sensitivity", "perturbation"), ("robustness", "sensitivity", "perturbation", "stability", "brittle"), True),
    ("empirical evaluation and benchmarking", (), ("evaluation", "benchmark", "analysis"), ("evaluation", "benchmark", "analysis", "empirical", "experiment"), True),
    ("theoretical understanding", ("mechanism", "theory", "theoretical", "understanding", "why", "analysis"), ("theory", "understanding", "mechanism"), ("theory", "theoretical", "understanding", "mechanism", "why", "analysis"), True),
    ("methods and improvements", (), ("method", "improvement", "approach"), ("improve", "method", "approach", "propose"), False),
)
ANYWHERE = {"robustness and sensitivity": ("robustness", "sensitivity"), "theoretical understanding": ("understanding", "mechanism")}  # cues that count inside words, too
CORE_STOPS = ("the", "and", "for", "with", "from", "this", "that", "are", "was", "has", "can", "its")
NARROW = ("cs.LG", "cs.CL", "stat.ML")
FIELDS = ("ti:", "abs:", "au:", "cat:")


def _text(x: Column | str) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def phrases(x: Column | str, most: int = 8) -> Column:
    """The text's words of three characters or more that are no stop words: all of them as one phrase, then each; distinct, ``most`` at most."""
    words = F.filter(F.split(F.lower(_text(x)), r"(?U)\W+"), lambda w: (F.length(w) > 2) & ~w.isin(*STOPS))
    return F.when(F.size(words) > 0, F.slice(F.array_distinct(F.concat(F.array(F.array_join(words, " ")), words)), 1, most)).otherwise(F.array().cast("array<string>"))


def either_field(x: Column, quoted: bool = True) -> Column:
    """Title or abstract has the words."""
    q = F.lit('"' if quoted else "")
    return F.concat(F.lit("(ti:"), q, x, q, F.lit(" OR abs:"), q, x, q, F.lit(")"))


def fielded(x: Column | str, known: list[str]) -> Column:
    """A plain text as a fielded query: its quoted phrases and the known ones that the rest holds, longest first; without any, its first four long words; a fielded one as it is.

    A known phrase that stands only inside longer known ones is not named again.
    """
    text = _text(x)
    quoted = F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1))
    rest, named = F.trim(F.lower(F.regexp_replace(text, '"[^"]+"', ""))), []
    for p in sorted(known, key=len, reverse=True):
        named.append(F.when(F.contains(rest, F.lit(p)), F.lit(p)))
        rest = F.replace(rest, F.lit(p), F.lit(" "))
    found = F.concat(quoted, F.array_compact(F.array(*named)) if named else F.array().cast("array<string>"))
    words = F.filter(F.split(rest, r"\s+"), lambda w: (F.length(w) > 3) & w.rlike(r"^\p{L}+$"))
    by_phrase = F.array_join(F.transform(found, lambda p: either_field(p)), " AND ")
    by_word = F.concat(F.lit("("), F.array_join(F.transform(F.slice(words, 1, 4), lambda w: either_field(w, False)), " OR "), F.lit(")"))
    plain = F.when(F.size(found) > 0, by_phrase).when(F.size(words) > 0, by_word).otherwise(text)
    return F.when(F.exists(F.array(*[F.lit(o) for o in FIELDS]), lambda o: F.contains(text, o)), text).otherwise(plain)


def rules(spark: SparkSession) -> DataFrame:
    """The facets' rules as a table: a row for each."""
    rows = [(i, label, list(cues), list(ANYWHERE.get(label, ())), list(more), list(needed), narrow) for i, (label, cues, more, needed, narrow) in enumerate(RULES)]
    return spark.createDataFrame(rows, "place int, label string, cues array<string>, inside array<string>, more array<string>, needed array<string>, narrow boolean")


def facets(queries: DataFrame, categories: list[str], min_year: int, excludes: list[str]) -> DataFrame:
    """(qid, place, label, keywords, include, exclude, categories, min_year): the facets of every query (qid, text) by the rules whose cues it has."""
    none = F.array().cast("array<string>")
    listed = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else none
    low = F.lower(_text("text"))
    words = F.filter(F.split(low, r"(?U)\W+"), lambda w: F.length(w) > 2)
    asked = queries.select("qid", low.alias("low"), words.alias("words"), F.array_distinct(F.filter(words, lambda w: ~w.isin(*CORE_STOPS))).alias("core"))
    met = asked.crossJoin(F.broadcast(rules(queries.sparkSession)))  # five rules
    holds = (F.size("cues") == 0) | F.arrays_overlap("words", "cues") | F.exists("inside", lambda c: F.contains(F.col("low"), c))
    keywords = F.when(F.size("more") > 0, F.concat(F.slice("core", 1, 3), "more")).otherwise(F.slice("core", 1, 5))
    include = F.when(F.size("needed") == 0, F.slice("core", 1, 3)).when(F.col("narrow"), F.col("needed")).otherwise(F.concat(F.slice("core", 1, 2), "needed"))
    allowed = F.when(F.col("narrow"), listed([c for c in categories if c in NARROW])).otherwise(listed(categories))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("place")).alias("place")
    return met.where(holds).select("qid", place, "label", keywords.alias("keywords"), include.alias("include"), listed(excludes).alias("exclude"), allowed.alias("categories"), F.lit(min_year).alias("min_year"))

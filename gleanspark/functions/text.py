"""Column expressions for documents, terms and grams. All run inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What separates words, what is stripped from a term's ends, what marks a word's ends in a gram.
SEPARATORS = r'\[newline\]|\[NEWLINE\]|[,"”“?!]'
SPACES = r"[ \t\n\x0B\f\r\x1C-\x1F]+"
EDGES = ',.#@:"'
MARK = "$"
#: Weight of a logarithm in term and document frequencies.
SCALE = 1000.0


def preprocess(text: Column) -> Column:
    """Separators become one space each, then everything beyond ASCII goes without a trace."""
    return F.regexp_replace(F.regexp_replace(text, SEPARATORS, " "), r"[^\x00-\x7F]", "")


def raw_tokens(text: Column) -> Column:
    """The words of a text in order, repeats included; a null text has none."""
    parts = F.filter(F.split(preprocess(text), SPACES), lambda w: w != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def normalize(text: Column) -> Column:
    """Lower case without edge signs; the empty string is a legal term."""
    return F.btrim(F.lower(text), F.lit(EDGES))


def normalize_text(text: str) -> str:
    """normalize() for a literal on the driver."""
    return text.lower().strip(EDGES)


def tokens_of(text: str) -> list[str]:
    """preprocess, split and normalize for a literal query on the driver."""
    import re

    plain = re.sub(r"[^\x00-\x7F]", "", re.sub(SEPARATORS, " ", text))
    return [normalize_text(w) for w in re.split(SPACES, plain) if w]


def tf(n: Column) -> Column:
    return F.when(n < 1, F.lit(0.0)).otherwise((1 + F.log10(F.greatest(n, F.lit(1)).cast("double"))) * SCALE)


def idf(df: Column, total: Column) -> Column:
    """log10(total / df), scaled; an error where df is 0 or more than total."""
    bad = (df == 0) | (total < df)
    return F.when(bad, F.raise_error(F.lit("document frequency must be in 1..number of documents")).cast("double")).otherwise(F.log10(total.cast("double") / F.when(~bad, df)) * SCALE)


def is_ignored(term: Column) -> Column:
    """Terms that get no grams."""
    return term.startswith("https:")


def grams(term: Column, k: int = 2) -> Column:
    """Grams of a marked term in order: the marked beginning, then k letters at each place, tails marked.

    With k of 3 and more the tails get shorter: abc has $ab, abc, bc$ and c$.
    """
    head = F.concat(F.lit(MARK), F.substring(term, 1, k - 1))
    n = F.length(term)
    tails = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.when(i - 1 + k >= n + 1, F.concat(F.substr(term, i), F.lit(MARK))).otherwise(F.substr(term, i, F.lit(k))),
    )
    return F.when(n == 0, F.array(F.lit(MARK))).otherwise(F.concat(F.array(head), tails))


def wildcard_grams(pattern: str, k: int = 2) -> list[str]:
    """Grams of a pattern that hold no star, normalized; a pattern of stars and single letters has none."""
    lead = [] if pattern.startswith("*") else [MARK + pattern[: k - 1]]
    body = [pattern[i : i + k] if i + k <= len(pattern) else pattern[i:] + MARK for i in range(len(pattern))]
    return [normalize_text(g) for g in lead + body if "*" not in g]


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a pattern with stars."""
    import re

    return "^" + ".*".join(re.escape(part) for part in pattern.lower().split("*")) + "$"


def cosine(q: Column, d: Column) -> Column:
    """struct(similarity, err) of two arrays; a zero norm gives similarity 1 and a remark."""

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    norm = F.sqrt(dot(q, q)) * F.sqrt(dot(d, d))
    return F.when(norm == 0, F.struct(F.lit(1.0).alias("similarity"), F.lit("provided query is very common").alias("err"))).otherwise(
        F.struct((dot(q, d) / F.when(norm != 0, norm)).alias("similarity"), F.lit(None).cast("string").alias("err"))
    )


def query_similarity(query_tf: Column, query_idf: Column, doc_tf: Column, doc_idf: Column) -> Column:
    """cosine of the elementwise products of term and inverse document frequencies."""
    return cosine(F.zip_with(query_tf, query_idf, lambda a, b: a * b), F.zip_with(doc_tf, doc_idf, lambda a, b: a * b))

"""Text renderings of small collected results, on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.editdist import MISSING
from ..operators import index, kgram

#: How many postings, words or members a line shows, and the longest bar of a chart.
SHOWN, SHOWN_MEMBERS, BAR = 3, 2, 30
HEADER = f"[{'TERM':13} - DOC_COUNT - IDF] -> [DOC - TERM_COUNT - TF]\n{'-' * 60}\n"


def _some(parts: list[str], total: int, most: int) -> str:
    return str(parts) if total <= most else f"{str(parts)[:-1]},...]"


def inverted_index(posts: DataFrame, vocabulary: DataFrame, n: int = 0) -> str:
    """A line for each term by first appearance, with its first postings."""
    shown = index.head(vocabulary, n)
    top = index.first_postings(posts.join(shown.select("term"), "term", "left_semi"), SHOWN)
    lists = {r.term: sorted(r.p) for r in top.groupBy("term").agg(F.collect_list(F.struct("rn", "doc_id", "cnt", "tf")).alias("p")).collect()}
    out = HEADER
    for t in shown.collect():
        parts = [f"{p.doc_id} - {p.cnt} - {round(p.tf):5}" for p in lists.get(t.term, [])]
        out += f"[{t.term:18}- {t.df:4} -{round(t.idf):5}] -> {_some(parts, t.df, SHOWN)}\n"
    return out


def index_stats(stats: DataFrame, sparse: bool = False) -> str:
    """A bar for each document frequency; sparse adds the frequencies that no term has."""
    rows = {r.df: r.terms for r in stats.collect()}
    total = sum(rows.values())
    out = ""
    for df in range(1, max(rows, default=0) + 1) if sparse else sorted(rows):
        n = rows.get(df, 0)
        bar = f"{'.' * BAR}|" if n > BAR else "." * n
        out += f"{n:5} ({round(100 * n / total, 2):5.2f}%) terms in {df:4} docs|{bar}\n"
    return out


def _listing(kind: str, of: str, what: str, rows: list[tuple], verbose: bool) -> str:
    title, count = f"[{kind} text]", f"[Count in {of}]"
    head = f"\n{title:20} \t{count:>15} \t[first {SHOWN} {what}]" if verbose else f"\n{title:20} \t{count:15}"
    out = f"{head}\n{'-' * len(head)}{'--------' if verbose else '-'}"
    for text, n, first in rows:
        out += f"\n{text:20} \t{n:15}" + (f" \t{first}" if verbose else "")
    return out


def terms(posts: DataFrame, vocabulary: DataFrame, n: int = 10, verbose: bool = True) -> str:
    shown = index.head(vocabulary, n)
    top = index.first_postings(posts.join(shown.select("term"), "term", "left_semi"), SHOWN)
    lists = {r.term: [x.doc_id for x in sorted(r.p)] for r in top.groupBy("term").agg(F.collect_list(F.struct("rn", "doc_id")).alias("p")).collect()}
    return _listing("Term", "docs", "occurances", [(t.term, t.df, lists.get(t.term, [])) for t in shown.collect()], verbose)


def grams(table: DataFrame, n: int = -1, verbose: bool = True) -> str:
    """The first n grams as they come, then in order; a negative n means all."""
    words = kgram.words_of(table)
    rows = (words if n < 0 else words.limit(n)).orderBy("gram").select("gram", F.size("words").alias("n"), F.slice("words", 1, SHOWN).alias("w")).collect()
    return _listing("Gram", "words", "words", [(r.gram, r.n, list(r.w)) for r in rows], verbose)


def document(doc) -> str:
    return f"{doc['doc_id']}" + (f" \tauthored by {doc['author_id']}" if doc["author_id"] else "") + (f" \tat {doc['timestamp']}" if doc["timestamp"] else "")


def edit_matrix(a: str, b: str, matrix: list[list[int]]) -> str:
    top = "\n      " + ", ".join(a) + "\n"
    return top + "-" * (len(top) - 1) + "\n" + "".join(f"{letter}|{list(row)}\n" for letter, row in zip(" " + b, matrix))


def edit_matrix_detailed(a: str, b: str, rows: list[list[tuple[int, int, int, int]]]) -> str:
    """rows: (diag, above, left, best) of each cell; what is missing stays blank."""

    def sign(v: int) -> str:
        return " " if v == MISSING else str(v)

    top = "\n          " + "    , ".join(a) + "\n"
    out = top + "-" * (len(top) - 1) + "\n"
    for letter, row in zip(" " + b, rows):
        upper = " ".join(f"/{sign(c[0])}, {sign(c[1])}\\" for c in row)
        lower = ",".join(f"\\{sign(c[2])}, {sign(c[3])}/" for c in row)
        out += f"{letter}|{upper}\n |{lower}\n\n"
    return out


def confusion(cm: DataFrame, order: list[str] | None = None) -> str:
    cells = {(r.actual, r.predicted): r.n for r in cm.collect()}
    labels = order or sorted({a for a, _ in cells})
    out = "\n " + " " * 8 + "".join(f" {x:>10}" for x in labels) + "\n"
    for a in labels:
        out += f"{a:8}| " + "".join(f"{cells.get((a, p), 0):10} " for p in labels) + "\n"
    return out


def _lines(title: str, rows: dict[str, list[str]], order: list[str] | None) -> str:
    return f"\n{title}\n" + "".join(f"{label:10}| {', '.join(rows[label]) or '-'}\n" for label in (order or sorted(rows)) if label in rows)


def _by_label(cm: DataFrame, names: dict[str, str] | None) -> tuple[dict[tuple[str, str], int], list[str]]:
    known = {(r.actual, r.predicted): r.n for r in cm.collect()}
    if names is not None:
        known = {(names[a], names[p]): n for (a, p), n in known.items() if a in names and p in names}
    return known, sorted({x for pair in known for x in pair})


def true_positives(cm: DataFrame, names: dict[str, str] | None = None, order: list[str] | None = None) -> str:
    """How many documents of each label were given it; labels by name and in an order where given."""
    known, labels = _by_label(cm, names)
    return _lines("true positives", {x: [str(known.get((x, x), 0))] for x in labels}, order)


def false_positives(cm: DataFrame, names: dict[str, str] | None = None, order: list[str] | None = None) -> str:
    """For each label the documents of others that were given it."""
    known, labels = _by_label(cm, names)
    return _lines("false positives", {x: [f"{known[a, x]} of {a}" for a in labels if a != x and known.get((a, x))] for x in labels}, order)


def true_negatives(cm: DataFrame, names: dict[str, str] | None = None, order: list[str] | None = None) -> str:
    """For each label its documents that were given another. The name is kept for compatibility."""
    known, labels = _by_label(cm, names)
    return _lines("true negatives", {x: [f"{known[x, p]} as {p}" for p in labels if p != x and known.get((x, p))] for x in labels}, order)


def ranked_page(rows: list, most: int = 60) -> str:
    """Documents with doc_id, rank and text in the order given, with the beginning of each text on one line."""
    out = ""
    for i, r in enumerate(rows, 1):
        text = " ".join((r.text or "").split())
        out += f"{i:3}. {r.rank:8.4f}  {r.doc_id}  {text[:most]}{'...' if len(text) > most else ''}\n"
    return out


def perceptron(n_documents: int, rows: DataFrame) -> str:
    return f"{n_documents}-{rows.count()}"


def weights(rows: DataFrame) -> str:
    return "\nterm      | weight\n" + "".join(f"{r.term:10}| {r.weight}\n" for r in rows.collect())


def clusters(assigned: DataFrame, centroids: list[list[float]]) -> str:
    """assigned(id, cid, ...): a line for each cluster with its size and first members."""
    place = F.row_number().over(Window.partitionBy("cid").orderBy("id"))
    first = {r.cid: sorted(r.ids) for r in assigned.withColumn("rn", place).where(F.col("rn") <= SHOWN_MEMBERS).groupBy("cid").agg(F.collect_list("id").alias("ids")).collect()}
    size = {r.cid: r[1] for r in assigned.groupBy("cid").count().collect()}
    out = ""
    for i, c in enumerate(centroids):
        at = f"({', '.join(str(round(v, 3)) for v in c)})" if len(c) <= 10 else f"point in {len(c)} dimensions"
        out += f"- Cluster #{i} | centroid: {at:14} | {size.get(i, 0)} instances | {_some([str(x) for x in first.get(i, [])], size.get(i, 0), SHOWN_MEMBERS)}\n"
    return out


def linked(items: list, backwards: bool = False) -> str:
    shown = [f"[{x}]" for x in (reversed(items) if backwards else items)]
    return ("<-" if backwards else "->").join(shown)

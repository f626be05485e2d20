"""Sample documents whose published results the tests hold on to."""

DOC1 = ("6428", "\nHello World,\nThis is a test document to do some information retrieval, not as big as Shakespear's docs, nor as small as a one-liner.\n")
DOC2 = (
    "1451",
    "\nThis is a more advanced test document imagine you work only with one document, testing wouldn't be as efficient as working with two.\n"
    "Information retrieval is about capturing information from structured text.\nText mining is about capturing information from unstructured text.\n",
)
DOC3 = ("8888", "\nMorocco did a great job in Fifa World Cup 2022 that was played in Qatar. More information about the match is out of the scope of this text\n")


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id string, text string")

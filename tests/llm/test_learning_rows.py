"""What the quality classifier learns from."""

from pyspark.sql import functions as F

from merchantlens.llm import quality


def test_a_repeated_document_is_learned_once(spark, documents, monkeypatch):
    learned = []
    monkeypatch.setattr(quality, "co_train", lambda text, meta, y, *rest: learned.append((len(y), len(rest[1]))))
    rows = [(n, f"text number {n}") for n in range(60)]
    hot = documents([(7, "one text")]).crossJoin(spark.range(3000)).drop("id")
    other = hot.withColumn("text", F.lit("another text"))
    docs = documents(rows).unionByName(hot).unionByName(other)
    labels = spark.createDataFrame([(n, n % 2) for n in range(40)], "doc_id long, quality int")
    quality.fit(docs, labels)
    assert learned == [(40, 20)]

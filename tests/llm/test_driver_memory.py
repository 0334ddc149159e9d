from pathlib import Path

from metaloom.llm import toxicity


def resident():
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096 / 1e6


def test_training_gives_its_memory_back(spark, monkeypatch):
    """What lies on top of the freed memory keeps it from being given back by itself."""
    kept = []

    def fit(texts, labels):
        many = [bytes(1000) for _ in range(200_000)]
        kept.append(many[-1])
        return len(texts)

    monkeypatch.setattr(toxicity, "fit", fit)
    docs, labels = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    before = resident()
    assert toxicity.train(docs, labels) > 0 and resident() < before + 80

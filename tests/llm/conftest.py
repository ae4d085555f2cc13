import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def write_docs(spark, tmp_path_factory):
    """Writes (doc_id, text, source) rows, plus columns whose names clash with the operators' own, as a folder of tables."""

    def write(rows, benchmark=()):
        d = tmp_path_factory.mktemp("sf")
        clash = [(i, t, "en", s, len(t or ""), "x", "y", 1) for i, t, s in rows]
        spark.createDataFrame(clash, "doc_id long, text string, lang string, source string, n_chars long, shard string, _id string, size int").write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        spark.createDataFrame([(4, 1, 0), (5, 0, 1), (7, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
        return str(d)

    return write


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows and near copies."""
    base = " ".join(f"parola{i % 37} testo{i}" for i in range(120))
    return [
        (1, None, "a"), (2, "", "a"), (3, "   \n\t ", None), (4, base, "a"), (5, base, "b"), (5, base, "b"), (6, base.replace("testo60", "altro"), "b"), (None, base, "a"), (7, "uno due", "c"),
        (8, "UNO due", "c"), (9, "x" * 70_000, "c"), (10, "a\nb " * 9000, "a"), (11, "prima riga abbastanza lunga\nseconda", "a"), (12, "PRIMA RIGA ABBASTANZA LUNGA  \nterza", "a"),
        (13, " prima riga abbastanza lunga\n\nprima riga abbastanza lunga", "b"), (14, "\U0001f600 é" * 40, None),
    ]

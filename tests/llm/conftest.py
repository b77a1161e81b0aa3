"""Small documents with every odd case, in plain Python and as Parquet tables."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, key long, size long, component_id long, rank string, spans string, shard int"
BASE = " ".join(f"word{i * 7 % 97} and{i}" for i in range(60))
LONG = "\n".join(f"Line number {i} of a very long text, with words {i * i}." for i in range(4000))


def odd_documents():
    near = BASE.replace("word14 ", "changed ")
    texts = [
        BASE + "\nA shared line of text.", None, "", BASE.upper() + "\nA SHARED LINE OF TEXT.", near, LONG,
        "  A shared line of text. \nanother one, not shared\n\n", "short", "two words", "two words", "   \t\n\x0b ",
        "Écrire à jean.dupont@mail.example.com, tel +49 (030) 123-4567 8, ip 10.0.0.256 or 10.0.0.25.\n"
        "card 4111 1111 1111 1111 and 4111 1111 1111 1112", "x" * 30000,
        "Released under the MIT License.\nAll words here are free.", "A shared line of text.\nA shared line of text.",
        "!!! ### $$$ %%% ***" * 20, "日本語 テキスト <|endoftext|> 😀", near + " end",
    ]
    sources = ["a", None, "b", "a", "a", "c", "", "b", "a", "a", None, "b", "c", "b", "a", "b", "é", "a"]
    rows = [(i, t, "en", s, len(t or ""), None, 1, 2, 3, "r", "s", 4) for i, (t, s) in enumerate(zip(texts, sources))]
    rows.append((8, "two words", "en", "a", 9, None, 1, 2, 3, "r", "s", 4))  # a repeated row
    rows.append((None, "no identifier", None, "b", None, True, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def rows():
    return odd_documents()


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('odd')}/documents.parquet"
    spark.createDataFrame(odd_documents(), SCHEMA).repartition(3).write.parquet(path)
    return path


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('empty')}/documents.parquet"
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return path

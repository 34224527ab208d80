import pytest

#: Texts with the cases that every operator must handle.
ODD_TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "two words",
    "x" * 5000,
    "a b c " * 3000,
    "1 " * 20000,
    "\n\n\n",
    "É ü 漢字 😀 text with emoji 😀😀 and   no-break",
    "same text for two rows, repeated here as it is",
    "same text for two rows, repeated here as it is",
    "ends with a line\n",
    "tab\tand\x0bvertical\x0cform \x1c separators \x85 next",
    "it's '' 's 'tis \n's  's we'll",
]


@pytest.fixture
def odd_documents(spark):
    """The odd texts, a repeated row, and columns whose names clash with internal ones."""
    rows = [(i if i != 3 else None, t, 7, "x", "y") for i, t in enumerate(ODD_TEXTS)]
    rows.append(rows[10])
    return spark.createDataFrame(rows, "doc_id long, text string, row long, class string, base string")


@pytest.fixture
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string")

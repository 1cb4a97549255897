"""Shared by the tests of this folder."""


def same_rows(kept, docs) -> None:
    """``kept`` has rows of ``docs``, untouched."""
    assert kept.columns == docs.columns
    assert kept.exceptAll(docs).isEmpty()

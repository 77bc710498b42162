import __spark_entry__ as entry


def test_names():
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names)
    assert all(f"p{n}_found" in names for n in (1, 2, 4, 5))


def test_nothing_names_the_text_package_but_the_entry():
    import pathlib

    root = pathlib.Path(entry.__file__).parent
    for p in (root / "tidemark").rglob("*.py"):
        if "llm" not in p.parts:
            assert "tidemark.llm" not in p.read_text()

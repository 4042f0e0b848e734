from cairn.llm import queries


def test_all_run(spark, data):
    for name, query in queries.QUERIES.items():
        assert query(spark, data).count() > 0 or name == "join_j10_near_duplicates", name  # the small data hold no near duplicates


def test_columns(spark, data):
    columns = {"p2_found": ["memory_id"], "p3_found": ["chunk_id_a", "chunk_id_b"], "p5_found": ["memory_id", "kind", "char_start"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id", "char_start"]}
    for name, expected in columns.items():
        assert queries.QUERIES[name](spark, data).columns == expected


def test_nothing_else_imports_this_package():
    from pathlib import Path

    root = Path(queries.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "cairn.llm" not in path.read_text() and "import llm" not in path.read_text()

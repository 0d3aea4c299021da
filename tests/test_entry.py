import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from geoloom import workload

SF = "/root/testdata/sf0.001"


def table(rows, columns):
    return sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else repr(v) for v in (r[c] for c in columns)) for r in rows)


@pytest.mark.parametrize("name", sorted(workload.ORACLE_SQL))
def test_query_against_sql(spark, name):
    db = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    found = workload.QUERIES[name](spark, SF)
    expected = db.execute(workload.ORACLE_SQL[name]).to_arrow_table().to_pylist()
    columns = sorted(found.columns)
    assert not expected or columns == sorted(expected[0])
    assert table((r.asDict() for r in found.collect()), columns) == table(expected, columns)


def test_entry_has_rows(spark):
    assert not entry.entry(spark).isEmpty()


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("module", ["zstandard", "sentencepiece", "no_such_module"])
def test_a_missing_library_leaves_the_rest(module):
    code = f"import sys; sys.modules[{module!r}] = None; import __spark_entry__ as e; n = e.queries(); assert 'occ_points' in n and set(e.oracle_sql()) <= set(n); print(sum(k.startswith('op') and k[2].isdigit() for k in n))"
    root = Path(entry.__file__).parent
    done = subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120, capture_output=True, text=True)
    assert done.stdout.split()[-1] == ("0" if module == "zstandard" or not (root / "geoloom" / "llm").exists() else "10")


def test_the_rest_works_without_the_llm_folder(tmp_path):
    root = Path(entry.__file__).parent
    for p in root.rglob("*.py"):
        rel = p.relative_to(root)
        if "llm" not in rel.parts and rel.name != "corpus_pipeline.py" and rel.parts[0] not in ("tests", ".git"):
            (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / rel).write_bytes(p.read_bytes())
    code = "import __spark_entry__ as e; n = e.queries(); assert 'occ_points' in n and 'pipeline' not in n and not any(k.startswith('op1') for k in n)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})

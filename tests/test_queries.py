"""Every search-engine query against its SQL in DuckDB, on the smallest tables."""

import os
import shutil
import subprocess
import sys

import pandas as pd
import pytest

from trawl.plans import registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(frame, columns):
    return sorted(tuple("none" if pd.isna(v) else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)


@pytest.fixture(scope="module")
def twins(sf_dir, tmp_path_factory):
    """The smallest tables, with every page also under the other scheme: two addresses, one path."""
    import duckdb

    out = tmp_path_factory.mktemp("twins")
    c = duckdb.connect()
    for t in TABLES:
        if t != "pages":
            os.symlink(f"{sf_dir}/{t}.parquet", out / f"{t}.parquet")
    c.execute(f"CREATE TABLE given AS SELECT * FROM '{sf_dir}/pages.parquet'")
    other = "CASE WHEN starts_with(url, 'https:') THEN 'http' || substr(url, 6) ELSE 'https' || substr(url, 5) END"
    c.execute(f"COPY (FROM given UNION ALL SELECT page_id + 1000000, {other}, html || ' was' FROM given) TO '{out}/pages.parquet' (FORMAT parquet)")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{out}/{t}.parquet'")
    return str(out), c


def test_files_that_share_a_path_are_all_counted(spark, twins):
    folder, duck = twins
    got = registry.queries()["latest_per_path"](spark, folder).toPandas()
    want = duck.execute(registry.oracle_sql()["latest_per_path"]).df()
    assert rows(got, ["bytes", "db", "n"]) == rows(want, ["bytes", "db", "n"])


def test_results_tell_of_one_file_where_several_share_a_path(spark, twins):
    """SQL leaves open which of a database's files it tells of; here it is the smallest one found, whole."""
    folder, duck = twins
    got = {r["path"]: (r["size"], r["mtime"], r["kind"]) for r in registry.queries()["all_databases"](spark, folder).collect()}
    want = {p: (s, m, k) for p, s, m, k in duck.execute(f"SELECT path, size, mtime, kind FROM ({registry.oracle_sql()['all_databases']})").fetchall()}
    found = {}
    for url, page_id, html in duck.execute("SELECT url, page_id, html FROM pages").fetchall():
        path = "/web/" + url.split("://", 1)[1]
        if "was" in path.lower() or "was" in html.lower():
            found.setdefault(path, []).append((len(html.encode()), 1_700_000_000 + page_id * 60))
    shared = {path for path, files in found.items() if len(files) > 1}
    assert shared and got.keys() == want.keys()
    assert {p: r for p, r in got.items() if p not in shared} == {p: r for p, r in want.items() if p not in shared}
    for path in shared:
        assert got[path][:2] == min(found[path]) and want[path][:2] in found[path] and got[path][2] == want[path][2]


@pytest.fixture(scope="module")
def gaps(sf_dir, tmp_path_factory):
    """The smallest tables, with pages that lack html or a number beside others of their address or path that have them."""
    import duckdb

    out = tmp_path_factory.mktemp("gaps")
    c = duckdb.connect()
    for t in TABLES:
        if t != "pages":
            os.symlink(f"{sf_dir}/{t}.parquet", out / f"{t}.parquet")
    c.execute(f"CREATE TABLE given AS SELECT * FROM '{sf_dir}/pages.parquet'")
    added = [
        (2000, "https://x.org/one", None), (2001, "https://x.org/one", "it was so"), (2002, "https://x.org/one", "it was not"),
        (None, "https://x.org/was/two", None), (2003, "http://x.org/was/two", "was"),
        (None, "http://x.org/was/three", "was it"), (2004, "https://x.org/was/three", "it was"),
        (2005, "https://x.org/was/four", None), (None, None, "it was"),
    ]
    c.executemany("INSERT INTO given VALUES (?, ?, ?)", added)
    c.execute(f"COPY given TO '{out}/pages.parquet' (FORMAT parquet)")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{out}/{t}.parquet'")
    return str(out), c


@pytest.mark.parametrize("name", ["all_databases", "latest_per_path"])
def test_what_a_page_lacks_is_taken_from_the_next_one(spark, gaps, name):
    folder, duck = gaps
    got = registry.queries()[name](spark, folder).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_entry_imports_without_llm(tmp_path):
    """A copy of the repository without the training-data folders still lists every search query."""
    for name in ("trawl", "__spark_entry__.py"):
        at = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(at) else shutil.copy)(at, tmp_path / name)
    shutil.rmtree(tmp_path / "trawl" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.oracle_sql()), len(e.queries()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True)
    assert said.stdout.split() == ["True", str(len(registry.queries()))]


@pytest.mark.parametrize("library", ["xxhash", "tokenizers"])
def test_entry_imports_without_a_library_of_llm(tmp_path, library):
    """Without a library that only the training-data operators need, the search queries stay."""
    (tmp_path / f"{library}.py").write_text(f"raise ImportError('no {library} here', name='{library}')")
    code = "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 0 and 'kind_merge' in e.queries())"
    env = os.environ | {"PYTHONPATH": f"{tmp_path}{os.pathsep}{ROOT}"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True)
    assert said.stdout.split() == ["True"]


def test_nothing_outside_imports_llm():
    for folder, _, names in os.walk(os.path.join(ROOT, "trawl")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as f:
                        assert "trawl.llm" not in f.read(), name

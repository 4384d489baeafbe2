"""Statements in SQL, with the answers that a plain table gives."""

import pytest

from tidemark.errors import UniqueViolation, UnsupportedRename
from tidemark.sources.session import Session, statements, to_spark


@pytest.fixture
def session(spark, folder):
    s = Session(spark, folder)
    s.execute("CREATE TABLE kv (k bigint, v bigint)")
    return s


def rows(session, query):
    return [tuple(r) for r in session.execute(query).collect()]


def test_spelling():
    assert statements("SELECT ';--' ; -- a; b\n SELECT 1 - 2;") == ["SELECT ';--'", "SELECT 1 - 2"]
    assert to_spark("k = ANY(ARRAY[1,2]) AND v=ANY('{3,NULL}'::bigint[])") == "k IN (1,2) AND v IN (3,NULL)"
    assert to_spark("k = ANY (ARRAY(SELECT (1)))") == "k IN (SELECT (1))"
    assert to_spark("k = ANY('{}'::bigint[])") == "k IN (NULL)"
    assert to_spark("k <> ALL(ARRAY[1,2])") == "k NOT IN (1,2)"
    assert to_spark("SELECT 'k = ANY(x)', 'generate_series(1,2)'") == "SELECT 'k = ANY(x)', 'generate_series(1,2)'"
    assert statements("\\timing on\nSELECT 1;\n\\echo a; b\nSELECT 2") == ["SELECT 1", "SELECT 2"]
    assert to_spark("SELECT g FROM generate_series(1, 9, 2) g WHERE g > 1") == "SELECT g FROM (SELECT id AS g FROM range(1, (9) + 1, 2)) AS g WHERE g > 1"


def test_lookups(session):
    session.execute("INSERT INTO kv SELECT g, g*7 FROM generate_series(1,2000) g")
    assert rows(session, "SELECT v FROM kv WHERE k = 7") == [(49,)]
    assert rows(session, "SELECT count(*) FROM kv WHERE k = ANY(ARRAY[1,5,5,9999,NULL])") == [(2,)]
    assert rows(session, "SELECT count(v) FROM kv WHERE k = ANY(ARRAY(SELECT g FROM generate_series(1,2000,100) g))") == [(20,)]
    session.execute("PREPARE q(bigint[]) AS SELECT count(*), sum(v) FROM kv WHERE k = ANY($1)")
    assert rows(session, "EXECUTE q(ARRAY[1,2,3])") == [(3, 42)] and rows(session, "EXECUTE q('{4}')") == [(1, 28)]
    session.execute("PREPARE p(bigint) AS SELECT v FROM kv WHERE k = $1")
    assert rows(session, "EXECUTE p(11)") == [(77,)]
    assert "In(k, [1,2])" in rows(session, "EXPLAIN (COSTS OFF) SELECT v FROM kv WHERE k IN (1,2)")[0][0]


def test_series(session):
    assert rows(session, "SELECT g FROM generate_series(10, 1, -3) g ORDER BY g") == [(1,), (4,), (7,), (10,)]
    assert rows(session, "SELECT count(*) FROM generate_series(10, 1)") == [(0,)]
    assert rows(session, "SELECT sum(x) FROM (SELECT generate_series(5, 1, -2) AS x)") == [(9,)]
    assert rows(session, "SELECT count(*) FROM (SELECT 1 AS a, generate_series(5, 1))") == [(0,)]


def test_arrays(session):
    """Lists of keys and what they must count."""
    session.execute("INSERT INTO kv SELECT g, g*7 FROM generate_series(1,100000) g")
    session.execute("PREPARE q(bigint[]) AS SELECT count(*) FROM kv WHERE k = ANY($1)")
    assert rows(session, "EXECUTE q('{1,100,500,50000,99999}')") == [(5,)]
    assert rows(session, "EXECUTE q('{2,4,6,8,10,12,14,16,18,20,22,24,26,28,30}')") == [(15,)]
    assert rows(session, "EXECUTE q('{}')") == [(0,)] and rows(session, "EXECUTE q(ARRAY(SELECT generate_series(1, 7)))") == [(7,)]
    assert rows(session, "SELECT count(*) FROM kv WHERE k = ANY(ARRAY(SELECT generate_series(1,100000,100)))") == [(1000,)]
    assert rows(session, "SELECT count(*) FROM kv WHERE k = ANY('{1,100,500,50000,99999}'::bigint[])") == [(5,)]
    assert rows(session, "SELECT count(*) FROM kv WHERE k <> ALL(ARRAY[1,2,3])") == [(99_997,)]
    session.execute("PREPARE w(bigint, bigint) AS UPDATE kv SET v = $2 WHERE k = $1")
    session.execute("EXECUTE w(5, -3 + 1)")
    assert rows(session, "SELECT v FROM kv WHERE k = 5") == [(-2,)]
    session.execute("DEALLOCATE w")
    with pytest.raises(KeyError):
        session.execute("EXECUTE w(1, 2)")
    session.execute("PREPARE text AS SELECT '$1' AS a, $1 AS b")
    assert rows(session, "EXECUTE text('x; DROP TABLE kv')") == [("$1", "x; DROP TABLE kv")]


def test_another_session(spark, folder, session):
    """Rows that one connection writes and another reads."""
    session.run("INSERT INTO kv SELECT g, g*7 FROM generate_series(1,1000) g; INSERT INTO kv VALUES (123456, 42)")
    other = Session(spark, folder)
    assert rows(other, "SELECT count(*) FROM kv") == [(1001,)]
    assert rows(other, "SELECT v FROM kv WHERE k = 500") == [(3500,)]
    assert rows(other, "SELECT count(*) FROM kv WHERE k = ANY('{1,2,3,500,1000}'::bigint[])") == [(5,)]
    with pytest.raises(UniqueViolation):
        other.execute("INSERT INTO kv VALUES (500, 999)")
    stranger = Session(spark, f"{folder}/elsewhere")
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        stranger.execute("SELECT * FROM kv")
    other.execute("DROP TABLE kv")
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        session.execute("SELECT * FROM kv")


def test_savepoint_after_an_error(session):
    session.run("INSERT INTO kv VALUES (1,10); BEGIN; UPDATE kv SET v = 11 WHERE k = 1; SAVEPOINT a; INSERT INTO kv VALUES (7,1)")
    with pytest.raises(UniqueViolation):
        session.execute("INSERT INTO kv VALUES (7,2)")
    session.run("ROLLBACK TO SAVEPOINT a; INSERT INTO kv VALUES (8,3); COMMIT")
    assert rows(session, "SELECT k, v FROM kv ORDER BY k") == [(1, 11), (8, 3)]


def test_definitions(session):
    session.run("CREATE EXTENSION IF NOT EXISTS x; CREATE SERVER IF NOT EXISTS s FOREIGN DATA WRAPPER x; CREATE FOREIGN TABLE a (k bigint, v bigint) SERVER s; CREATE TABLE b (k bigint PRIMARY KEY, v bigint)")
    for bad in ("CREATE TABLE a (k bigint, v bigint)", "CREATE TABLE odd (name text, price double precision)", "CREATE TABLE odd (k bigint, v text)"):
        with pytest.raises(ValueError):
            session.execute(bad)
    session.run("CREATE TABLE IF NOT EXISTS a (k bigint, v bigint); DROP TABLE IF EXISTS none; DROP FOREIGN TABLE a")
    with pytest.raises(KeyError):
        session.execute("DROP TABLE a")


def test_transactions(session):
    session.run("BEGIN; INSERT INTO kv VALUES (1,10),(2,20);")
    assert rows(session, "SELECT count(*) FROM kv") == [(2,)]
    session.execute("ROLLBACK")
    assert rows(session, "SELECT count(*) FROM kv") == [(0,)]
    session.run("BEGIN; INSERT INTO kv VALUES (1,10),(2,20),(3,30); COMMIT")
    session.run("BEGIN; UPDATE kv SET v=999 WHERE k=1; SAVEPOINT a; DELETE FROM kv WHERE k=2; ROLLBACK TO a; COMMIT")
    assert rows(session, "SELECT k, v FROM kv ORDER BY k") == [(1, 999), (2, 20), (3, 30)]
    session.run("BEGIN; DELETE FROM kv WHERE k = 2; INSERT INTO kv VALUES (3, 999)")
    with pytest.raises(UniqueViolation):
        session.execute("COMMIT")
    with pytest.raises(UniqueViolation):
        session.run("BEGIN; INSERT INTO kv VALUES (8,1); INSERT INTO kv VALUES (8,2)")
    with pytest.raises(RuntimeError):
        session.execute("SELECT 1")
    session.execute("COMMIT")  # rolls back
    assert rows(session, "SELECT count(*) FROM kv") == [(3,)]


def test_keys(session):
    session.execute("INSERT INTO kv VALUES (1,10),(2,20)")
    with pytest.raises(UniqueViolation):
        session.execute("UPDATE kv SET k = 2 WHERE k = 1")
    for change in ("k = CASE WHEN k = 1 THEN 2 ELSE 1 END", "k = k + 1"):
        with pytest.raises(UnsupportedRename):
            session.execute(f"UPDATE kv SET {change} WHERE k IN (1,2)")
    session.execute("UPDATE kv SET k = k + 100, v = v + k")
    assert rows(session, "SELECT k, v FROM kv ORDER BY k") == [(101, 11), (102, 22)]


def test_tables(session):
    session.run("CREATE TABLE other (k bigint); INSERT INTO other VALUES (5); INSERT INTO kv (v, k) VALUES (1, 5), (2, 6)")
    assert rows(session, "SELECT a.k, a.v, b.v FROM kv a JOIN other b ON a.k = b.k") == [(5, 1, 0)]
    session.execute("DROP TABLE other")
    with pytest.raises(KeyError):
        session.execute("INSERT INTO other VALUES (1)")
    with pytest.raises(ValueError):
        session.execute("VACUUM kv")

import socketserver
import sqlite3
import threading

import pytest

from threadloom.operators import filters
from threadloom.sources import database, overview
from threadloom.sources.nntp import Client, ProtocolError

LINES = {n: f"{n}\ts{n}\tp\tMon, 01 Feb 2021 01:12:32 +0100\t<{n}@h>\t\t{n * 10}\t3\tXref: h g:{n}" for n in range(5, 15)}


class Handler(socketserver.StreamRequestHandler):
    def say(self, *lines):
        self.wfile.write("".join(x + "\r\n" for x in lines).encode())

    def handle(self):
        self.server.opened.append("open")
        self.say("200 hello")
        while line := self.rfile.readline().decode().strip():
            word, *rest = line.split()
            if word == "AUTHINFO":
                self.say("381 more" if rest[0] == "USER" else "281 welcome" if rest[1] == "secret" else "481 no")
            elif word == "GROUP":
                self.say("211 10 5 14 g" if rest[0] == "g" else "411 no such group")
            elif word == "LIST" and rest:
                self.say("215 order", "Subject:", "From:", "Date:", "Message-ID:", "References:", "Bytes:", "Lines:", "Xref:full", ".")
            elif word == "LIST":
                self.say("215 groups", "g 14 5 y", "empty 0 1 m", ".")
            elif word == "XOVER":
                a, b = map(int, rest[0].split("-"))
                got = [LINES[n] for n in range(a, b + 1) if n in LINES]
                self.say("224 follows", "..dots", *got, ".") if got else self.say("423 none")
            elif word == "QUIT":
                self.server.opened.append("quit")
                self.say("205 bye")
                return


@pytest.fixture
def server():
    s = socketserver.ThreadingTCPServer(("127.0.0.1", 0), Handler)
    s.daemon_threads, s.opened = True, []
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()
    s.server_close()


def test_client(server):
    with Client("127.0.0.1", server.server_address[1], "u", "secret", 5, tls=False) as c:
        assert c.group("g") == (10, 5, 14) and list(c.groups()) == [("g", 5, 14, "y"), ("empty", 1, 0, "m")]
        got = dict(c.over(5, 6))
        assert got[5]["Xref"] == "h g:5" and got[6]["Message-ID"] == "<6@h>" and None in got
        assert list(c.over(100, 110)) == []
        with pytest.raises(ProtocolError, match="411"):
            c.group("none")
        with pytest.raises(ValueError):
            c.group("g\r\nQUIT")
    with pytest.raises(ProtocolError, match="481"):
        Client("127.0.0.1", server.server_address[1], "u", "wrong", 5, tls=False)
    assert server.opened.count("quit") == 1


def test_loading_from_a_server(spark, server):
    overview.register(spark)
    options = {"transport": "nntp", "host": "127.0.0.1", "port": str(server.server_address[1]), "tls": "false"}
    df = spark.read.format("overview").options(**options, group="g", chunk="2", max_workers="3").load()
    assert df.rdd.getNumPartitions() == 3
    assert sorted((r["artnum"], r["subject"], r["bytes"], r["xref"]) for r in df.collect()) == [(n, f"s{n}", n * 10, f"h g:{n}") for n in range(5, 15)]
    assert server.opened.count("open") == server.opened.count("quit"), "every connection is closed"
    groups = spark.read.format("overview").options(**options, mode="groups").load()
    assert sorted(tuple(r) for r in groups.collect()) == [("empty", 1, 0, 0, "m"), ("g", 5, 14, 10, "y")]


def test_keys_of_every_record_count(spark):
    rows = [overview.article("g", n, r, False) for n, r in ((1, {"Subject": "a", "FROM": "b"}), (2, {"SUBJECT": "c", ":Message-id": "<m>"}))]
    assert [(r[1], r[3], r[4], r[2]) for r in rows] == [(1, "a", "b", None), (2, "c", "", "<m>")]


def test_database_files(spark, tmp_path):
    path = str(tmp_path / "g.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE articles (message_id TEXT, group_name TEXT, artnum INTEGER, subject TEXT, from_addr TEXT, date_utc TEXT, bytes INTEGER)")
        c.executemany("INSERT INTO articles VALUES (?, 'g', ?, 's', NULL, NULL, 1)", [(f"<{i}>", i) for i in range(250)])
        c.execute("DELETE FROM articles WHERE artnum BETWEEN 20 AND 30")
    with sqlite3.connect(str(tmp_path / "empty.db")) as c:
        c.execute("CREATE TABLE articles (message_id TEXT)")
    df = database.read(spark, [path, str(tmp_path / "empty.db")], rows=60)
    assert df.rdd.getNumPartitions() == 5
    assert sorted(r["artnum"] for r in df.collect()) == [i for i in range(250) if not 20 <= i <= 30]
    assert df.where("refs IS NULL AND group_name = 'g' AND bytes = 1").count() == 239


def test_described():
    assert filters.described() == "SELECT message_id, subject, from_addr, date_utc, bytes, artnum, group_name FROM articles"
    shown = filters.described(group="a'b", subject_like="x%y", not_from="n | m", terms=True)
    assert shown.endswith("WHERE group_name = 'a''b' AND subject LIKE '%x%' AND subject LIKE '%y%' AND from_addr NOT LIKE '%n%' AND from_addr NOT LIKE '%m%'")

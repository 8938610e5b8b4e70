import itertools
import json
import threading
import zlib
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from tessera.operators import sync as S
from tessera.sources import paged
from tessera.streaming.stateful import drained


class Service:
    """Objects by collection over HTTP; every answer fails some times first, by the list of statuses that a path has."""

    def __init__(self):
        self.objects, self.blocks, self.failures, self.asked = {}, {}, {}, []
        service = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                url, q = urlparse(self.path), {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
                service.asked.append((url.path, q, self.headers.get("Authorization")))
                left = service.failures.get(url.path, [])
                status, body = (left.pop(0), {}) if left else service.answer(url.path.strip("/").split("/"), q)
                self.send_response(status)
                if status == 429:
                    self.send_header("Retry-After", "2")
                self.end_headers()
                self.wfile.write(json.dumps(body).encode())

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.options = {"path": f"http://127.0.0.1:{self.server.server_port}", "token": "t", "size": "3", "pause": "0"}

    def answer(self, path, q):
        if path[0] == "head":
            rows = [{"edited": max((o["edited"] for os in self.objects.values() for o in os), default=-1)}]
        elif path == ["collections"]:
            rows = [{"id": c} for c in sorted(self.objects)]
        elif path[0] == "collections":
            rows = [o for o in self.objects[path[1]] if int(q.get("since", -1)) < o["edited"] <= int(q.get("until", 10**9))]
        elif path[1] in self.blocks:
            rows = self.blocks[path[1]]
        else:
            return 404, {"detail": "gone"}
        at, size = int(q.get("cursor", 0)), int(q["size"])
        return 200, {"results": rows[at : at + size], "has_more": at + size < len(rows), "next_cursor": str(at + size)}


@pytest.fixture
def service():
    s = Service()
    yield s
    s.server.shutdown()


def add(service, collection, id, edited, lines, children=()):
    service.objects.setdefault(collection, []).append({"id": id, "edited": edited, "title": f"T{id}"})
    set_blocks(service, id, lines, children)


def set_blocks(service, id, lines, children=()):
    service.blocks[id] = [{"id": f"{id}-{i}", "kind": "paragraph", "payload": {"rich_text": [{"plain_text": x}]}} for i, x in enumerate(lines)] + [{"id": c, "kind": "child_page", "payload": {"title": f"T{c}"}} for c in children]


def test_client_waits_and_tries_again():
    class Via:
        def __init__(self, *answers):
            self.answers = list(answers)

        def get(self, path, params, attempt):
            return self.answers.pop(0)

    def run(*answers):
        waits = []
        try:
            return paged.Client(Via(*answers), sleep=waits.append).answer("x"), waits
        except paged.ServiceError as e:
            return e.status, waits

    ok = (200, {}, {"a": 1})
    assert run((429, {"Retry-After": "7"}, {}), (429, {"Retry-After": "?"}, {}), (503, {}, {}), ok) == ({"a": 1}, [7.0, 1.0, 3.0])
    assert run(*[(500, {}, {})] * 5) == (500, [1.0, 2.0, 3.0, 4.0])
    assert run(*[(429, {}, {})] * 5) == (429, [1.0] * 4)
    assert run((403, {}, {}), ok) == (403, [])


def test_lists_end():
    class Loop:
        def get(self, path, params, attempt):
            return 200, {}, {"results": [params.get("cursor")], "has_more": True, "next_cursor": "a"}

    assert list(paged.Client(Loop()).results("x")) == [None, "a"]


def test_batch_reader_follows_cursors(spark, service):
    for i in range(17):
        add(service, f"c{i % 2}", str(i), i, [])
    service.failures = {"/collections": [503, 429], "/collections/c0": [500, 500]}
    spark.dataSource.register(paged.PagedSource)
    rows = spark.read.format("paged").options(**service.options, tasks="2").load().collect()
    assert sorted((r.collection, int(r.id), r.edited, json.loads(r.body)["title"]) for r in rows) == sorted((f"c{i % 2}", i, i, f"T{i}") for i in range(17))
    assert {a for _, _, a in service.asked} == {"Bearer t"} and all(q["size"] == "3" for _, q, _ in service.asked)
    service.objects = {}
    assert spark.read.format("paged").options(**service.options).load().count() == 0


def test_stream_goes_on_from_its_offset(spark, service, tmp_path):
    spark.dataSource.register(paged.PagedSource)
    stream = lambda: spark.readStream.format("paged").options(**service.options).load()
    for i in range(8):
        add(service, "a", str(i), i, [])
    assert drained(stream(), "paged", "append", folder=str(tmp_path)).count() == 8
    service.asked.clear()
    add(service, "b", "new", 20, [])
    service.objects["a"][3]["edited"] = 21
    rows = drained(stream(), "paged", "append", folder=str(tmp_path))  # started again from its checkpoint
    assert sorted((r.id, r.edited) for r in rows.collect()) == sorted([*((str(i), i) for i in range(8)), ("new", 20), ("3", 21)])
    assert all(q["since"] == "7" and q["until"] == "21" for p, q, _ in service.asked if p.startswith("/collections/"))


def test_two_syncs(spark, service):
    account = {"provider": "p", "account_id": "a", "display_name": "n"}
    add(service, "c", "r1", 1, ["one", " ", "two"] + ["x"] * 5, ["k1", "k2"])
    add(service, "c", "r2", 2, ["other"])
    set_blocks(service, "k1", ["kid"], ["r1", "k3"])  # a loop, and a further level
    set_blocks(service, "k3", [])
    other = spark.createDataFrame([("p", "b", "z", "page", "Z", "t", "h", "active", None, 0)], S.STATE)
    first = S.sync(spark, service.options, account, other, 1)
    docs = {(r.account_id, r.id): r for r in first.documents.collect()}
    assert set(docs) == {("b", "z"), *(("a", i) for i in ("r1", "r2", "k1", "k3"))}
    assert docs["a", "r1"].content == "one\ntwo\n" + "x\n" * 5 + "Tk1\nTk2" and docs["a", "k3"].content == "" and docs["a", "k1"].title == "Tk1"
    assert first.counts.first().asDict() == {"fetched": 4, "updated": 4, "unchanged": 0, "failed": 1, "discovered": 2}
    assert first.state.first().status == "partial"

    set_blocks(service, "r1", ["changed"])  # k1 is no longer linked, but known
    set_blocks(service, "k2", ["late"])
    del service.blocks["k3"]
    service.failures["/objects/r2/blocks"] = [500] * 5
    second = S.sync(spark, service.options, account, first.documents, 2)
    assert {r.id: r.action for r in second.actions.collect()} == {"r1": "updated", "r2": "failed", "k1": "unchanged", "k3": "deleted"}
    docs = {r.id: r for r in second.documents.where("account_id = 'a'").collect()}
    assert (docs["k3"].status, docs["k3"].content, docs["k3"].last_seen) == ("deleted", "", 1) and "404" in docs["k3"].error
    assert (docs["r2"].status, docs["r2"].content, docs["r2"].last_seen) == ("active", "other", 1) and "500" in docs["r2"].error
    assert (docs["r1"].content, docs["r1"].last_seen, docs["r1"].error) == ("changed", 2, None)

    third = S.sync(spark, service.options, account, second.documents, 3)
    assert {r.id: r.action for r in third.actions.collect()} == {"r1": "unchanged", "r2": "unchanged", "k1": "unchanged", "k3": "failed"}
    accounts = S.upsert_accounts(S.upsert_accounts(first.account, second.account), third.account)
    assert [r.updated_at for r in accounts.collect()] == [3]


def test_recorded_answers_are_read_bucket_by_bucket(spark, tmp_path):
    made = spark.range(1200).selectExpr("concat('objects/', id, '/blocks') path", "'' cursor", "cast(null as string) next", "array(200) statuses", "array('{}') results")
    paged.record(made, f"{tmp_path}/few", 7)
    paged.record(made, f"{tmp_path}/many")
    assert paged.buckets_of(f"{tmp_path}/few") == 7 and paged.buckets_of(f"{tmp_path}/many") == 16
    tasks = paged.placed(made.select("path"), f"{tmp_path}/few", made["path"], 3).rdd.map(lambda r: r["path"]).glom().collect()
    assert sum(map(len, tasks)) == 1200
    buckets = [[k for k, _ in itertools.groupby(zlib.crc32(p.encode()) % 7 for p in t)] for t in tasks]
    assert sorted(sum(buckets, [])) == list(range(7))  # each is opened once, by one task

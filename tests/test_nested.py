import json
import random

from tidewatch.operators import nested as N


def strip(x, names):
    if isinstance(x, dict):
        return {k: strip(v, names) for k, v in x.items() if k not in names}
    return [strip(v, names) for v in x] if isinstance(x, list) else x


def made(rnd, depth):
    kind = rnd.randrange(4) if depth else 0
    if kind == 0:
        return rnd.choice([1, -2, "text", 'quoted "code": text', None, True, "ü😀\n\t\\", "code"])
    if kind == 1:
        return [made(rnd, depth - 1) for _ in range(rnd.randrange(4))]
    return {k: made(rnd, depth - 1) for k in rnd.sample(["a", "code", "raw code", 'q"k', "raw_code", "é", "Code", "z", ""], rnd.randrange(5))}


def test_strip_keys_equals_plain(rows):
    rnd = random.Random(4)
    data = [(i, json.dumps(made(rnd, 6)), 1) for i in range(300)]
    data += [data[7], (900, None, 1), (901, "", 1), (902, "{oops", 1), (903, '{"code":1}', 1), (904, "[[[[[[{\"code\":{}}]]]]]]", 1), (905, '"code"', 1), (906, '{"b":1,"b":2}', 1)]
    got = sorted((r["id"], r["payload"]) for r in N.strip_keys(rows(data, "id long, payload string, parent int"), "payload").collect())
    want = []
    for i, text, _ in data:
        try:
            want.append((i, strip(json.loads(text), N.RAW_SOURCE_FIELDS)))
        except (TypeError, ValueError):
            want.append((i, None))
    want = [(i, None if i == 906 else x) for i, x in want]
    assert [(i, None if t is None else json.loads(t)) for i, t in got] == sorted(want, key=lambda r: r[0])
    assert dict(got)[903] == "{}" and dict(got)[904] == "[[[[[[{}]]]]]]"


def test_strip_keys_without_any(rows):
    df = rows([(1, '{ "b": 1, "a": [] }'), (2, None)], "id long, payload string")
    assert [tuple(r) for r in N.strip_keys(df, "payload").collect()] == [(1, '{"a":[],"b":1}'), (2, None)]
    assert N.strip_keys(df.limit(0), "payload").count() == 0
    assert N.strip_keys(df, "payload", ["b"]).filter("id = 1").first()["payload"] == '{"a":[]}'


def test_repository_and_numbers(rows):
    cases = [('{"_repository":{"owner":"o","repository":"r"}}', "o/r"), ('{"_repository":{"repository":"r"}}', "r"), ('{"_repository":{"owner":"o","repository":""}}', "o"),
             ('{"_repository":"x"}', "x"), ('{"_repository":7}', ""), ('{}', ""), (None, ""), ("{", ""), ('{"_repository":{"owner":null}}', "")]
    got = rows(cases, "s string, want string").select(N.repository_name("s").alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)
    assert [r[0] for r in rows([("7",), (" 8 ",), ("x",), (None,), ("",), ("99999999999",)], "n string").select(N.int_or("n", 3)).collect()] == [7, 8, 3, 3, 3, 3]

"""The structural index accepts exactly the texts that a JSON parser accepts and finds the same children."""

import json
import random

from vocabula.operators.nested import Index, children

LISTS = {"aliases": ("alias", "id"), "codeLocations": ("codeLocation", "id"), "changedFiles": ("changedFile", "number")}


def _refuse(x):
    raise ValueError(x)


class Repeated(Exception):
    """A key stands twice in an object: the index reads what is nested in either value, a parser only the last."""


def _once(pairs):
    if len(dict(pairs)) < len(pairs):
        raise Repeated
    return dict(pairs)


def load(text):
    return json.loads(text, parse_constant=_refuse, object_pairs_hook=_once)


def is_text(x):
    return isinstance(x, str) and x.strip()[:1] in ("{", "[", '"') and x.strip() != '"'


def brute(text):
    out = []

    def walk(v, key):
        if isinstance(v, dict):
            for name, (child, own) in LISTS.items():
                if name in v:
                    at = v.get(own)
                    at = key if at is None or isinstance(at, (dict, list)) else at if isinstance(at, str) else json.dumps(at)
                    w = v[name]
                    if is_text(w):
                        try:
                            w = load(w)
                        except ValueError:
                            pass
                    out.extend((at, child, i) for i, x in enumerate(w if isinstance(w, list) else [w]) if x is not None)
            for k, x in v.items():
                if not (k in LISTS and isinstance(x, str)):
                    walk(x, k)
        elif isinstance(v, list):
            for x in v:
                walk(x, None)
        elif is_text(v):
            try:
                walk(load(v), None)
            except ValueError:
                pass

    try:
        walk(load(text), None)
    except ValueError:
        return None
    return out


def make(rnd, depth=0):
    r = rnd.random()
    if depth > 5 or r < 0.3:
        return rnd.choice([None, True, 1, -2.5, "x", 'a"b\\', "[1", '{"aliases":[1,null],"id":"q"}', "é ", [], {}])
    if r < 0.6:
        return [make(rnd, depth + 1) for _ in range(rnd.randint(0, 4))]
    return {rnd.choice(["a", "aliases", "id", "number", "changedFiles", "codeLocations", "x y", ""]): make(rnd, depth + 1) for _ in range(rnd.randint(0, 4))}


def test_against_a_parser():
    rnd = random.Random(1)
    texts = ["", "null", "01", "-0", "1.", "1.5e3", '"a', '"a\\"', '"\\x"', '"\\u12G4"', '"\\u1234"', "[1,]", "[,1]", '{"a":1,}', '{"a"}', '{"a":}', "{1:2}", "[]]", "[[]", '{"a":[}]}', '"a" "b"', "nul", "[1 2]", "[\t1\n]", '"tab\there"', ":", '{"a"::1}', "[1:2]", "}{", "][", '"\\\\"', '\\"a"', '[""]']
    whole = [json.dumps(make(rnd), ensure_ascii=rnd.random() < 0.5, indent=rnd.choice([None, 1])) for _ in range(800)]
    for s in whole:
        cut = list(s)
        k = rnd.randrange(len(cut))
        cut[k : k + 1] = rnd.choice([[], [rnd.choice('{}[]:,"\\ 1an')], [cut[k], rnd.choice('{}[]:,"\\ 1an')]])
        texts.append("".join(cut))
    texts += whole
    found: dict = {}
    for i, at, child, place, value in children(texts, LISTS):
        json.loads(value)
        found.setdefault(i, []).append((at, child, place))
    ix = Index([t.encode() for t in texts])
    good = set(ix.payload[ix.good].tolist())
    for i, t in enumerate(texts):
        try:
            want = brute(t)
        except Repeated:
            continue
        assert (want is not None) == (i in good), t
        assert sorted(map(str, found.get(i, []))) == sorted(map(str, want or [])), t

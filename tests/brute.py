"""Plain, single-threaded statements of the data problems, for comparison."""

import json
from collections import Counter, defaultdict
from decimal import Decimal

import pyarrow.parquet as pq


def read(sf_dir, name):
    return pq.read_table(f"{sf_dir}/{name}.parquet").to_pylist()


def parse(text):
    try:
        return json.loads(text, parse_float=Decimal)
    except (ValueError, TypeError):
        return ...


def leaves(o, prefix=""):
    out = {}
    for k, v in o.items():
        if isinstance(v, dict):
            out |= leaves(v, prefix + k + ".")
        else:
            out[prefix + k] = v
    return out


def same(a, b):
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, (int, Decimal)) and isinstance(b, (int, Decimal)):
        return a == b
    if type(a) is not type(b):
        return False
    if isinstance(a, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict):
        return all(same(a.get(k), b.get(k)) for k in a.keys() | b.keys())
    return a == b


def unequal(x, y):
    a, b = parse(x), parse(y)
    if not (isinstance(a, dict) and isinstance(b, dict)):
        return [] if x == y else [""]
    a, b = leaves(a), leaves(b)
    return [p for p in a.keys() | b.keys() if not same(a.get(p), b.get(p))]


def kind(v):
    for t, name in ((bool, "boolean"), (str, "string"), (list, "array"), (int, "integer"), (Decimal, "double")):
        if isinstance(v, t):
            return name


def p1(rows):
    when, fields, values = {}, defaultdict(lambda: defaultdict(Counter)), defaultdict(dict)
    for r in rows:
        f = (r["table_name"], r["file_id"])
        when[f] = r["written_at"]
        o = parse(r["row_value"])
        if isinstance(o, dict):
            for p, v in leaves(o).items():
                fields[f][p][kind(v)] += 1
                values[f, p][r["row_key"]] = v
    out, by = set(), defaultdict(list)
    for (t, f), w in when.items():
        by[t].append((w, f))
    for t, files in by.items():
        files.sort()
        for (_, f0), (_, f1) in zip(files, files[1:]):
            old, new = fields[t, f0], fields[t, f1]
            for p in old.keys() & new.keys():
                a, b = (Counter({k: n for k, n in x[p].items() if k}).most_common(1) for x in (old, new))
                if a and b and a[0][0] != b[0][0]:
                    out.add((t, f1, "retyped", p, ""))
            ended, started = old.keys() - new.keys(), new.keys() - old.keys()
            scored = []
            for p in ended:
                for q in started:
                    x, y = values[(t, f0), p], values[(t, f1), q]
                    keys = [k for k in x.keys() & y.keys() if x[k] is not None and y[k] is not None]
                    equal = sum(kind(x[k]) == kind(y[k]) and same(x[k], y[k]) for k in keys)
                    if equal * 2 > len(keys):
                        scored.append((-equal / len(keys), -len(keys), p, q))
            for _, _, p, q in sorted(scored):
                if p in ended and q in started:
                    ended, started = ended - {p}, started - {q}
                    out.add((t, f1, "renamed", q, p))
            out |= {(t, f1, "removed", p, "") for p in ended} | {(t, f1, "added", p, "") for p in started}
    return out


def p2(rows, spec):
    out = set()

    def held(v):
        if isinstance(v, str):
            w = parse(v)
            return w if isinstance(w, (dict, list)) else v
        return v

    def walk(r, o, names, at, parent, arrays):
        name, path = names[0], [*at, names[0]]
        if not isinstance(o, dict):
            return
        v = held(o.get(name))
        label = ".".join(path)
        if not any(a == label or a.endswith("." + label) and a == ".".join(r["_done"] + path) for a in arrays):
            return walk(r, v, names[1:], path, parent, arrays)
        v = [v] if isinstance(v, dict) else v
        for i, e in enumerate(v if isinstance(v, list) else []):
            e = held(e)
            if isinstance(e, dict):
                node = f"{parent}.{label}[{i}]" if parent else f"{label}[{i}]"
                if len(names) == 1:
                    out.add((r["table_name"], r["row_key"], parent, node))
                else:
                    walk(r | {"_done": r["_done"] + path}, e, names[1:], [], node, arrays)

    for r in rows:
        record = held(parse(r["row_value"]))
        for array in spec.get(r["table_name"], []):
            walk(r | {"_done": []}, record, array.split("."), [], "", spec[r["table_name"]])
    return out


def p4(leader, follower, status):
    def newest(rows):
        best = {}
        for r in rows:
            k = r["table_name"], r["row_key"]
            if k not in best or r["seq"] > best[k]["seq"]:
                best[k] = r
        return best

    a, b = newest(leader), newest(follower)
    node = {r["table_name"]: r["node_id"] for r in follower}
    applied = {}
    for r in sorted(status, key=lambda r: r["reported_at"]):
        applied[r["table_name"], r["node_id"]] = r["last_applied_seq"]
    out = set()
    for k in a.keys() | b.keys():
        x, y = a.get(k), b.get(k)
        limit = applied.get((k[0], node.get(k[0])))
        if x and limit is not None and x["seq"] > limit:
            continue
        live_x, live_y = x and not x["is_deleted"], y and not y["is_deleted"]
        if live_x and live_y:
            out |= {(*k, "differs", p) for p in unequal(x["row_value"], y["row_value"])}
        elif live_x or live_y:
            out.add((*k, "leader_only" if live_x else "follower_only", ""))
    return out


def p6(rows):
    tables = defaultdict(lambda: defaultdict(dict))
    for r in rows:
        held = tables[r["table_name"]][r["snapshot_seq"]]
        held[r["row_key"]] = min(held.get(r["row_key"], r["row_value"]), r["row_value"])
    out = set()
    for t, snaps in tables.items():
        order = sorted(snaps)
        for s0, s1 in zip(order, order[1:]):
            a, b = snaps[s0], snaps[s1]
            out |= {(t, s1, k, "added") for k in b.keys() - a.keys()} | {(t, s1, k, "removed") for k in a.keys() - b.keys()}
            out |= {(t, s1, k, "changed") for k in a.keys() & b.keys() if unequal(a[k], b[k])}
    return out

"""Plain Python statements of the pN_found problems, to test the operators against on small tables."""

from __future__ import annotations

import ast
import json
import re
from collections import defaultdict
from datetime import datetime
from urllib.parse import unquote


def p1(rows):
    """rows: (id, predicted, actual)."""
    out = set()
    for rid, *fields in rows:
        for name, raw in zip(("predicted_nodes", "actual_nodes"), fields, strict=True):
            body = (raw or "").strip()
            single = bool(re.match(r"[\[({]\s*'", body))
            while len(body) > 1 and body[0] + body[-1] in ("[]", "()", "{}"):
                body = body[1:-1].strip()
            q = "'" if single else '"'
            pos = 0
            for quoted, bare in re.findall(rf"{q}((?:[^{q}\\]|\\.|{q}{q})*){q}|([^,;|；，、\s]+)", body):
                v = (bare or re.sub(r"\\(.)", r"\1", quoted).replace(q + q, q)).strip()
                if v:
                    pos += 1
                    out.add((rid, name, pos, v))
    return out


def p2_edges(edges, nodes):
    """edges: (edge_id, org, source, target, seen_at); nodes: (org, node, added, removed)."""
    spans = defaultdict(set)
    for org, node, a, b in nodes:
        if None not in (org, node, a):
            spans[org.strip(), node.strip()].add((a, b or datetime.max))
    out = set()
    for eid, org, s, t, at in edges:
        for field, key in (("source", s), ("target", t)):
            if key is None:
                continue
            own = spans.get(((org or "").strip(), key.strip()), set())
            if any(a <= at < b for a, b in own):
                continue
            reason = "deleted" if any(a <= at for a, _ in own) else "late" if own else "missing"
            out.add(("org_edges", eid, field, key.strip(), reason, at.strftime("%Y-%m")))
    return out


def lists(dump):
    try:
        d = json.loads(dump or "null")
    except ValueError:
        return {}
    if not isinstance(d, dict):
        return {}
    return d.get("AuthorizationDetails") or d


def listed(v):
    return v if isinstance(v, list) else [] if v is None else [v]


def p2_dumps(dumps, catalog):
    """dumps: (dump_id, account, captured_at, dump); catalog: (arn, created, retired)."""
    own, refs = defaultdict(set), set()
    for did, acc, at, dump in dumps:
        d = lists(dump)
        for p in listed(d.get("Policies")):
            own[acc, (p.get("Arn") or "").strip()].add((at, did))
        for kind in ("UserDetailList", "GroupDetailList", "RoleDetailList"):
            for e in listed(d.get(kind)):
                for p in listed(e.get("AttachedManagedPolicies")):
                    if (p.get("PolicyArn") or "").strip():
                        refs.add((did, acc, at, p["PolicyArn"].strip()))
    cat = {a.strip(): (c, r) for a, c, r in catalog}
    out = set()
    for did, acc, at, arn in refs:
        mine = own.get((acc, arn), set())
        c, r = cat.get(arn, (None, None))
        if any(d == did for _, d in mine) or c and c <= at and (r is None or r > at):
            continue
        reason = "deleted" if any(t < at for t, _ in mine) or c and c <= at else "late" if mine or c else "missing"
        out.add(("account_dump", did, "PolicyArn", arn, reason, at.strftime("%Y-%m")))
    return out


def p3(dumps):
    """dumps: (dump_id, dump)."""
    out = set()
    for did, dump in dumps:
        d = lists(dump)
        for kind in ("UserDetailList", "GroupDetailList", "RoleDetailList"):
            for i, e in enumerate(listed(d.get(kind)), 1):
                if kind == "UserDetailList":
                    out |= {(did, kind, i, "GroupList", j, g or "") for j, g in enumerate(listed(e.get("GroupList")), 1)}
                    for j, p in enumerate(listed(e.get("UserPolicyList")), 1):
                        doc = p.get("PolicyDocument")
                        if isinstance(doc, str):
                            doc = json.loads(unquote(doc) if doc.lstrip().startswith("%") else doc)
                        out.add((did, kind, i, "UserPolicyList", j, (doc or {}).get("Version") or ""))
                out |= {(did, kind, i, "AttachedManagedPolicies", j, (p.get("PolicyArn") or "").strip()) for j, p in enumerate(listed(e.get("AttachedManagedPolicies")), 1)}
    return out


def walk(x, path=""):
    if isinstance(x, list):
        for y in x:
            yield from walk(y, path)
    elif isinstance(x, dict):
        for k, v in x.items():
            p = f"{path}.{k}" if path else k
            yield p, {type(None): None, bool: "boolean", int: "number", float: "number", str: "string", list: "array", dict: "object"}[type(v)], v
            yield from walk(v, p)


def p4(history, files):
    """history: topology values; files: (file_id, family, content)."""
    out = set()
    tops = [t for t in history if t is not None]
    out |= {("topology_type", t) for t in set(tops) if tops.count(t) >= 0.05 * len(tops)}
    values, seen = [], set()
    for fid, family, content in files:
        if family == "lambda_execution_role" and fid not in seen:
            seen.add(fid)
            values += [y for p, _, v in walk(json.loads(content)) if p.rpartition(".")[2].lower().startswith("resource") and not p.startswith("Trust") for y in listed(v) if isinstance(y, str)]
    return out | {("Resource", v) for v in set(values) if values.count(v) >= 0.05 * len(values)}


def p5(files):
    """files: (file_id, feed, exported_at, content)."""
    feeds = defaultdict(dict)
    for fid, feed, at, content in files:
        feeds[feed][fid] = (at, fid, content)
    out = set()
    for own in feeds.values():
        order = [(fid, c) for _, fid, c in sorted(own.values())]
        types = []
        for _, c in order:
            t = defaultdict(set)
            for p, kind, _ in walk(json.loads(c)):
                t[p] |= {kind} - {None}
            types.append(t)
        n, moves = len(order), {"added": defaultdict(set), "removed": defaultdict(set)}
        for p in {p for t in types for p in t}:
            at = [i for i, t in enumerate(types) if p in t]
            if len(at) >= 2 and at[-1] - at[0] + 1 == len(at):
                if at[0] >= 2:
                    moves["added"][at[0]].add(p)
                if n - 1 - at[-1] >= 2:
                    moves["removed"][at[-1] + 1].add(p)
            kinds = [(i, t[p]) for i, t in enumerate(types) if t.get(p)]
            if all(len(k) == 1 for _, k in kinds):
                flips = [j for j in range(1, len(kinds)) if kinds[j][1] != kinds[j - 1][1]]
                if len(flips) == 1 and flips[0] >= 2 and len(kinds) - flips[0] >= 2:
                    out.add((order[kinds[flips[0]][0]][0], "type", p, ""))
        parent = lambda p: p.rpartition(".")[0]
        for i in set(moves["added"]) | set(moves["removed"]):
            left = {k: {p for p in m[i] if parent(p) not in m[i]} for k, m in moves.items()}
            for q in {parent(p) for s in left.values() for p in s}:
                a, r = ({p for p in left[k] if parent(p) == q} for k in ("added", "removed"))
                if len(a) == len(r) == 1:
                    out.add((order[i][0], "renamed", *r, *a))
                else:
                    out |= {(order[i][0], "added", p, "") for p in a} | {(order[i][0], "removed", p, "") for p in r}
    return out


def statement(raw):
    text = raw.strip()
    if text.startswith("{"):
        try:
            d = json.JSONDecoder().raw_decode(text)[0]
        except ValueError:
            d = ast.literal_eval(text[: text.rindex("}") + 1])
        return {k: listed(v) for k, v in d.items()}
    if re.match(r"[^\n=\[]+=\[", text):
        return {s.partition("=[")[0]: s.strip()[:-1].partition("=[")[2].split(", ") for s in text.split(" | ")}
    if re.match(r"[^\n:=]+ = ", text):
        return {ln.partition(" = ")[0]: ln.partition(" = ")[2].split(", ") for ln in text.split("\n")}
    out, key = {}, None
    for ln in text.split("\n"):
        if ln.lstrip().startswith("- "):
            out[key].append(ln.lstrip()[2:])
        else:
            key, _, v = ln.partition(":")
            out[key] = [v] if v.strip() else []
    return out


def p6(rows):
    """rows: (record_id, family, raw)."""
    small = lambda s: "".join(c for c in s.lower() if c.isalnum())
    groups = defaultdict(set)
    for rid, family, raw in rows:
        if raw is not None:
            groups[family, frozenset((small(k), tuple(small(x) for x in v)) for k, v in statement(raw).items())].add(rid)
    return {(min(g), r) for g in groups.values() for r in g if r != min(g)}

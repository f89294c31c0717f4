"""Reports of a run: text, JSON and EDN, from findings that fit on a screen."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

#: Versions of this program, and of the trees that units are turned into.
VERSION, NORMALIZER = "0.2", 1
NAMES = {"introduced": "INTRODUCED", "shifted": "SHIFTED", "already_there": "ALREADY THERE", "found": "FOUND"}
#: Contracted pairs that a text report lists.
LISTED = 20


@dataclass
class Place:
    """One side of a finding."""

    path: str
    start_line: int
    end_line: int
    identity: str
    nodes: int
    touched: bool = False
    language: str = "ruby"

    def at(self) -> str:
        return f"{self.path}:{self.start_line}-{self.end_line}"


@dataclass
class Finding:
    label: str
    kind: str
    score: float
    copy: Place
    others: list[tuple[Place, float]]
    hint: str
    payoff: float
    primitive: str | None = None
    more: int = 0  # other places that aren't listed


@dataclass
class Result:
    """What a run found: the first rows of each list, how many there are of each in all, and tables with all of them."""

    findings: list[Finding] = field(default_factory=list)
    kept: list[dict] = field(default_factory=list)  # score, a, b, path, line, heading, new_clause
    contracted: list[tuple[str, str, float]] = field(default_factory=list)
    clause_errors: list[tuple[str, int, str]] = field(default_factory=list)
    parse_errors: list[tuple[str, int, str]] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    base: str | None = None
    exit_code: int = 0
    totals: dict[str, int] = field(default_factory=dict)  # of labels, kept and contracted; where missing, what is listed
    tables: dict[str, DataFrame] = field(default_factory=dict)


def counts(result: Result) -> dict[str, int]:
    out: dict[str, int] = {}
    for f in result.findings:
        out[f.label] = out.get(f.label, 0) + 1
    return out | {"kept": len(result.kept), "contracted": len(result.contracted)} | result.totals


def _several(n: int, noun: str) -> str:
    return f"{n} {noun}{'' if n == 1 else 's'}"


def _rows(rows: list[tuple[str, Place, float | None]]) -> list[str]:
    wide = max(len(p.at()) for _, p, _ in rows)
    name = max(len(p.identity) for _, p, _ in rows)
    return [f"  {word:<9} {p.at():<{wide}}  {p.identity:<{name}}{'' if s is None else f'  {round(s, 2)}'}".rstrip() for word, p, s in rows]


def text(result: Result) -> str:
    """A report to read."""
    number = counts(result)
    said = [f"{number[k]} {k.replace('_', ' ')}" for k in (*NAMES, "kept", "contracted") if number.get(k)]
    if result.clause_errors:
        said.append(_several(len(result.clause_errors), "contract error"))
    if result.parse_errors:
        said.append(_several(len(result.parse_errors), "parse error"))
    base = f"   base {result.base[:7]}" if result.base else ""
    out = [f"dry: {', '.join(said or ['failing' if result.exit_code else 'clean'])}{base}", *(f"note: {n}" for n in result.notes)]
    for f in result.findings:
        kind = f"fragment, {f.copy.end_line - f.copy.start_line + 1} lines" if f.kind == "fragment" else f.kind
        out += ["", f"{NAMES[f.label]}  {round(f.score, 2)}  {kind}"]
        first = ("new" if f.copy.touched else "copy", f.copy, None)
        out += _rows([first, *(("existing", p, s if len(f.others) > 1 else None) for p, s in f.others)])
        if f.more:
            out.append(f"  and {f.more} more")
        out.append(f"  hint      {f.hint}")
    if (rest := sum(number.get(k, 0) for k in NAMES) - len(result.findings)) > 0:
        out += ["", f"and {_several(rest, 'finding')} more"]
    for k in result.kept:
        flag = "  NEW CLAUSE, review its reason" if k["new_clause"] else ""
        out += ["", f"KEPT  {round(k['score'], 2)}  {k['path']}:{k['line']} \"{k['heading']}\"{flag}", *_rows([("side", k["a"], None), ("side", k["b"], None)])]
    if result.contracted:
        out += ["", "CONTRACTED", *(f"  {a} no longer matches {b} ({round(s, 2)} at base)" for a, b, s in result.contracted[:LISTED])]
        if number["contracted"] > LISTED:
            out.append(f"  and {number['contracted'] - LISTED} more")
    if result.clause_errors or result.parse_errors:
        out += ["", *(f"CONTRACT  {p}:{n}: {m}" for p, n, m in result.clause_errors), *(f"PARSE     {p}:{n}: {m}" for p, n, m in result.parse_errors)]
    return "\n".join(out) + "\n"


def _place(p: Place, **more: float) -> dict:
    return {"path": p.path, "start_line": p.start_line, "end_line": p.end_line, "identity": p.identity, "nodes": p.nodes, "touched": p.touched, **more}


def as_json(result: Result) -> str:
    """Everything, for programs."""
    error = lambda e: dict(zip(("path", "line", "message"), e, strict=True))
    whole = {
        "version": VERSION,
        "check": "dry",
        "normalizer": NORMALIZER,
        "base": result.base,
        "exit_code": result.exit_code,
        "counts": counts(result),
        "notes": result.notes,
        "findings": [
            {"class": f.label, "score": round(f.score, 2), "kind": f.kind, "copy": _place(f.copy), "existing": [_place(p, score=round(s, 2)) for p, s in f.others], "hint": f.hint, "payoff": f.payoff, "primitive": f.primitive}
            for f in result.findings
        ],
        "kept": [{"score": round(k["score"], 2), "a": _place(k["a"]), "b": _place(k["b"]), "clause": {x: k[x] for x in ("path", "line", "heading")}, "new_clause": k["new_clause"]} for k in result.kept],
        "contracted": [{"a": a, "b": b, "score": round(s, 2)} for a, b, s in result.contracted],
        "contract_errors": [error(e) for e in result.clause_errors],
        "parse_errors": [error(e) for e in result.parse_errors],
    }
    return json.dumps(whole, indent=2, ensure_ascii=False)


def as_edn(result: Result) -> str:
    """A row for each pair of a copy and another place."""
    quoted = lambda x: json.dumps(x, ensure_ascii=False)  # noqa: E731 - EDN escapes strings as JSON does
    side = lambda p: f'{{:file {quoted(p.path)}, :start-line {p.start_line}, :end-line {p.end_line}}}'
    rows = [
        f'{{:score {round(s, 12)}\n   :language {quoted(f.copy.language)}\n   :left {side(f.copy)}\n   :right {side(p)}\n   :left-nodes {f.copy.nodes}\n   :right-nodes {p.nodes}}}'
        for f in result.findings
        for p, s in f.others
    ]
    return "{:candidates\n [" + "\n  ".join(rows) + "]}\n"


RENDERERS = {"text": text, "json": as_json, "edn": as_edn}


def render(result: Result, form: str) -> str:
    if form not in RENDERERS:
        raise ValueError(f"unknown format {form!r}")
    return RENDERERS[form](result)

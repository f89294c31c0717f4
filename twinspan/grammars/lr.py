"""LALR(1) tables from a grammar, with lookaheads by DeRemer and Pennello's relations, and a parser driven by them.

A grammar is text: ``%left``, ``%right`` and ``%nonassoc`` lines from the loosest to the tightest, then rules
``name: a b | c %prec T ;``. Symbols without a rule are terminals. The first rule's name is the start symbol. Conflicts
are settled by precedence, else a shift wins, else the earlier rule.
"""

from __future__ import annotations

from collections.abc import Callable, Container, Iterable, Iterator
from dataclasses import dataclass, field

END = "$end"


@dataclass
class Tables:
    """actions: per state, token to state (shift, > 0), rule (reduce, -rule - 1) or 0 (accept); gotos: per state, name to
    state; rules: (name, length)."""

    actions: list[dict[str, int]]
    gotos: list[dict[str, int]]
    rules: list[tuple[str, int]]
    conflicts: list[str] = field(default_factory=list)
    rights: list[tuple[str, ...]] = field(default_factory=list)


def _read(text: str) -> tuple[list[tuple[str, tuple[str, ...], str | None]], dict[str, tuple[int, str]]]:
    rules: list[tuple[str, tuple[str, ...], str | None]] = []
    precedence: dict[str, tuple[int, str]] = {}
    body: list[str] = []
    for line in text.splitlines():
        line = line.split("//")[0].strip()
        if line.startswith(("%left", "%right", "%nonassoc")):
            kind, *tokens = line.split()
            level = len({x[0] for x in precedence.values()}) + 1
            precedence |= {t: (level, kind[1:]) for t in tokens}
        elif line:
            body += line.split()
    name, current, prec = "", [], None
    k = 0
    while k < len(body):
        word = body[k]
        if word.endswith(":") and len(word) > 1 and not name:
            name = word[:-1]
        elif word in ("|", ";"):
            rules.append((name, tuple(current), prec))
            current, prec = [], None
            if word == ";":
                name = ""
        elif word == "%prec":
            k += 1
            prec = body[k]
        else:
            current.append(word)
        k += 1
    return rules, precedence


def _closure_digraph(nodes: Iterable, edges: dict, start: dict) -> dict:
    """Least sets with start[x] in f(x) and f(y) in f(x) for every edge x to y (Tarjan's components, iteratively)."""
    result = {x: set(start.get(x, ())) for x in nodes}
    depth: dict = {}
    stack: list = []
    for root in list(result):
        if root in depth:
            continue
        work: list[tuple[object, Iterator]] = []
        depth[root] = len(stack) + 1
        stack.append(root)
        work.append((root, iter(edges.get(root, ()))))
        low = {root: depth[root]}
        while work:
            x, it = work[-1]
            advanced = False
            for y in it:
                if y not in depth:
                    depth[y] = low[y] = len(stack) + 1
                    stack.append(y)
                    work.append((y, iter(edges.get(y, ()))))
                    advanced = True
                    break
                low[x] = min(low[x], low.get(y, depth[y]) if depth[y] != float("inf") else float("inf"))
                result[x] |= result[y]
            if advanced:
                continue
            work.pop()
            if low[x] == depth[x]:
                while True:
                    y = stack.pop()
                    depth[y] = float("inf")
                    if y == x:
                        break
                    result[y] = result[x]
            if work:
                parent = work[-1][0]
                low[parent] = min(low[parent], low[x])
                result[parent] |= result[x]
    return result


def build(text: str) -> Tables:
    """The LALR(1) tables of a grammar."""
    read, precedence = _read(text)
    first_name = read[0][0]
    rules = [("$start", (first_name, END), None), *read]
    names = {r[0] for r in rules}
    by_name: dict[str, list[int]] = {}
    for k, r in enumerate(rules):
        by_name.setdefault(r[0], []).append(k)
    nullable: set[str] = set()
    grown = True
    while grown:
        grown = False
        for name, right, _ in rules:
            if name not in nullable and all(s in nullable for s in right):
                nullable.add(name)
                grown = True

    closures: dict[frozenset, frozenset] = {}

    def closure(kernel: frozenset) -> frozenset:
        found = closures.get(kernel)
        if found is None:
            items, todo, seen = set(kernel), list(kernel), set()
            while todo:
                rule, dot = todo.pop()
                right = rules[rule][1]
                if dot < len(right) and right[dot] in names and right[dot] not in seen:
                    seen.add(right[dot])
                    for k in by_name[right[dot]]:
                        if (k, 0) not in items:
                            items.add((k, 0))
                            todo.append((k, 0))
            found = closures[kernel] = frozenset(items)
        return found

    start = frozenset({(0, 0)})
    states, index = [start], {start: 0}
    moves: list[dict[str, int]] = []
    for kernel in states:
        after: dict[str, set] = {}
        for rule, dot in closure(kernel):
            right = rules[rule][1]
            if dot < len(right):
                after.setdefault(right[dot], set()).add((rule, dot + 1))
        own = {}
        for symbol in sorted(after):
            target = frozenset(after[symbol])
            if target not in index:
                index[target] = len(states)
                states.append(target)
            own[symbol] = index[target]
        moves.append(own)

    jumps = [(s, n) for s, own in enumerate(moves) for n in own if n in names]
    direct = {(s, n): {t for t in moves[moves[s][n]] if t not in names} for s, n in jumps}
    reads = {(s, n): [(moves[s][n], m) for m in moves[moves[s][n]] if m in nullable] for s, n in jumps}
    read_sets = _closure_digraph(jumps, reads, direct)
    includes: dict[tuple[int, str], list] = {x: [] for x in jumps}
    lookback: dict[tuple[int, int], list] = {}
    for s, n in jumps:
        for rule in by_name[n]:
            right, at = rules[rule][1], s
            for k, symbol in enumerate(right):
                if symbol in names and all(x in nullable for x in right[k + 1 :]):
                    includes[(at, symbol)].append((s, n))
                at = moves[at][symbol]
            lookback.setdefault((at, rule), []).append((s, n))
    follow = _closure_digraph(jumps, includes, read_sets)

    actions: list[dict[str, int]] = []
    conflicts: list[str] = []
    for s, kernel in enumerate(states):
        own: dict[str, int] = {}
        shifts = {t: target for t, target in moves[s].items() if t not in names}
        for token, target in shifts.items():
            own[token] = target
        for rule, dot in sorted(closure(kernel)):
            name, right, prec = rules[rule]
            if dot < len(right) or rule == 0:
                continue
            tokens: set[str] = set().union(*(follow[x] for x in lookback.get((s, rule), [])))
            strength = precedence.get(prec or next((x for x in reversed(right) if x not in names), ""))
            for token in tokens:
                if token in shifts and own.get(token, 0) > 0:
                    other = precedence.get(token)
                    if strength and other:
                        if strength[0] > other[0] or strength[0] == other[0] and strength[1] == "left":
                            own[token] = -rule - 1
                        elif strength[0] == other[0] and strength[1] == "nonassoc":
                            del own[token]
                    else:
                        conflicts.append(f"state {s}, {token}: shift or {name} -> {' '.join(right)}")
                elif token in own and own[token] < 0:
                    conflicts.append(f"state {s}, {token}: {name} -> {' '.join(right)} or rule {-own[token] - 1}")
                    own[token] = max(own[token], -rule - 1)
                elif token not in shifts:
                    own[token] = -rule - 1
        if END in moves[s] and (0, 1) in kernel:
            own[END] = 0
        actions.append(own)
    gotos = [{n: t for n, t in own.items() if n in names} for own in moves]
    return Tables(actions, gotos, [(r[0], len(r[1])) for r in rules], conflicts, [r[1] for r in rules])


def parse(tables: Tables, tokens: list[str], reduced: Callable[[int, int, int], bool] | None = None, asked: Container[int] = range(1 << 30)) -> int | None:
    """Parse the whole token stream: None where it is a text of the grammar, else the index of the first token that no
    text with this beginning can have. ``reduced(rule, first, last)`` may reject a rule over tokens first..last - 1; it is
    asked about the rules in ``asked``."""
    actions, gotos, rules = tables.actions, tables.gotos, tables.rules
    stack, starts = [0], [0]
    state, k, n = 0, 0, len(tokens)
    token = tokens[0] if n else END
    while True:
        act = actions[state].get(token)
        if act is None:
            return k
        if act > 0:
            stack.append(act)
            if reduced:
                starts.append(k)
            state = act
            k += 1
            token = tokens[k] if k < n else END
        elif act == 0:
            return None
        else:
            rule = -act - 1
            name, size = rules[rule]
            if reduced:
                begin = starts[-size] if size else k
                if rule in asked and not reduced(rule, begin, k):
                    return k - 1
                if size:
                    del starts[-size:]
                starts.append(begin)
            if size:
                del stack[-size:]
            state = gotos[stack[-1]][name]
            stack.append(state)


def derive(tables: Tables, tokens: list[str], made: Callable[[str, tuple[str, ...], list, int, int], object], passing: Container[int] = ()) -> object:
    """What ``made(name, right side, parts, first, last)`` makes of a text, bottom-up; a part is a token's index or what was
    made of the rule there, and first..last - 1 are the rule's tokens. Rules in ``passing`` have one part, and stand for it unless it is None. None where
    the text isn't of the grammar."""
    actions, gotos, rules = tables.actions, tables.gotos, tables.rules
    stack, parts, starts = [0], [], []
    k, n = 0, len(tokens)
    while True:
        act = actions[stack[-1]].get(tokens[k] if k < n else END)
        if act is None:
            return None
        if act == 0:
            return parts[0]
        if act > 0:
            stack.append(act)
            parts.append(k)
            starts.append(k)
            k += 1
            continue
        rule = -act - 1
        name, size = rules[rule]
        if rule in passing and parts[-1] is not None:
            stack[-1] = gotos[stack[-2]][name]
            continue
        own = parts[len(parts) - size :]
        begin = starts[len(starts) - size] if size else k
        value = made(name, tables.rights[rule], own, begin, k)
        if size:
            del stack[-size:], parts[-size:], starts[-size:]
        parts.append(value)
        starts.append(begin)
        stack.append(gotos[stack[-1]][name])

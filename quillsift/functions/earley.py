"""A weighted context-free grammar and an Earley parser that keeps the highest-scoring parse.

A grammar is text, one rule a line: ``Left -> Right ... ; weight``.  Names all in capitals are terminals.
The parser works on a sequence of terminal names only, so equal sequences have equal parses: callers keep
parses by sequence.  There are no empty rules.
"""

from __future__ import annotations


class Grammar:
    def __init__(self, text: str, start: str):
        self.rules: list[tuple[str, tuple[str, ...], float]] = []
        for line in text.splitlines():
            line = line.split("#")[0].strip()
            if not line:
                continue
            left, right = line.split("->")
            right, _, weight = right.partition(";")
            for option in right.split("|"):
                self.rules.append((left.strip(), tuple(option.split()), float(weight or 0)))
        self.of: dict[str, list[int]] = {}
        for i, (left, _, _) in enumerate(self.rules):
            self.of.setdefault(left, []).append(i)
        self.start = start

    def parse(self, tokens: tuple[str, ...]):
        """The best parse as ``(score, [(name, first, end), ...])`` of all nonterminals in it, or None."""
        n = len(tokens)
        rules, of = self.rules, self.of
        # a column maps (rule, dot, origin) to (score, back); back links to the item before and the child completed
        columns: list[dict] = [{} for _ in range(n + 1)]
        waits: list[dict[str, set]] = [{} for _ in range(n + 1)]  # items of a column by the nonterminal they wait for

        def predict(name: str, at: int, agenda: list) -> None:
            for r in of[name]:
                key = (r, 0, at)
                if key not in columns[at]:
                    columns[at][key] = (rules[r][2], None)
                    agenda.append(key)

        agenda: list = []
        predict(self.start, 0, agenda)
        for at in range(n + 1):
            column = columns[at]
            done: dict[tuple[str, int], float] = {}
            while agenda:
                key = agenda.pop()
                r, dot, origin = key
                score, back = column[key]
                left, right, _ = rules[r]
                if dot == len(right):
                    if done.get((left, origin), float("-inf")) >= score:
                        continue
                    done[left, origin] = score
                    node = (left, origin, at, (key, at), back)
                    for waiting in list(waits[origin].get(left, ())):
                        wr, wd, wo = waiting
                        ws, wb = columns[origin][waiting]
                        new = (wr, wd + 1, wo)
                        if new not in column or column[new][0] < ws + score:
                            column[new] = (ws + score, (wb, node))
                            agenda.append(new)
                    continue
                symbol = right[dot]
                if symbol in of:
                    waits[at].setdefault(symbol, set()).add(key)
                    predict(symbol, at, agenda)
                    if (symbol, at) in done:  # cannot be: there are no empty rules
                        raise AssertionError
                elif at < n and tokens[at] == symbol:
                    new = (r, dot + 1, origin)
                    old = columns[at + 1].get(new)
                    if old is None or old[0] < score:
                        columns[at + 1][new] = (score, (back, None))
            if at < n:
                agenda = sorted(columns[at + 1], key=lambda k: k[2])  # the latest origins are completed first
                if not agenda:
                    return None
        best = max(((columns[n][k], k) for k in columns[n] if rules[k[0]][0] == self.start and k[1] == len(rules[k[0]][1]) and k[2] == 0), default=None, key=lambda x: x[0][0])
        if best is None:
            return None
        (score, back), _ = best
        spans = [(self.start, 0, n)]
        todo = [back]
        while todo:
            link = todo.pop()
            while link is not None:
                link, node = link
                if node is not None:
                    spans.append((node[0], node[1], node[2]))
                    if node[4] is not None:
                        todo.append(node[4])
        spans.sort(key=lambda s: (s[1], -s[2]))
        return score, spans

"""Plain versions of the text operators, for comparison."""

from quillsift.llm.leakage import characters, words


def leaks(documents, items):
    """``{(item_id, doc_id): longest run}`` by looking every window up in every document."""
    out = {}
    grams: dict = {}
    for item, text, lang in items:
        blankless = (lang or "").strip().lower()[:2] in ("zh", "ja")
        t = characters(text or "") if blankless else words(text or "")
        w = 20 if blankless else 12
        for i in range(len(t) - w + 1):
            grams.setdefault((w, tuple(t[i : i + w])), set()).add(item)
    for doc, text in documents:
        for w, t in ((12, words(text or "")), (20, characters(text or ""))):
            for i in range(len(t) - w + 1):
                for item in grams.get((w, tuple(t[i : i + w])), ()):
                    out[item, doc] = True
    return set(out)

"""Brute-force versions that share no code with the operators."""

import hashlib
import re


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similarity(a, b):
    return 1 - edit_distance(a, b) / max(len(a), len(b), 1)


def classes(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


ODD_DOCS = [(1, None, 5), (2, "", 6), (3, "one two three", 7), (3, "one two three", 7), (None, "no id at all here, none", 8), (4, "word " * 30000, 9), (5, "!!! ???", None)]
ODD_SCHEMA = "doc_id long, text string, n_words int"

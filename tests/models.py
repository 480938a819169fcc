"""Plain Python models of the rules, used only to check the operators."""

from __future__ import annotations

import re

CONTROL = "".join(map(chr, range(33)))
NAME_CUT = 30


def trim(s):
    return s.strip(CONTROL)


def method_name(line):
    clean = trim(line.replace("{", ""))
    words = re.split(r"\s+", clean)
    for i, w in enumerate(words):
        if "(" in w:
            head = w.split("(", 1)[0]
            if head:
                return head
            if i > 0:
                return words[i - 1]
    return clean[:NAME_CUT]


def javadoc(text):
    lines = [trim(x) for x in text.split("\n")]
    inside, hits = False, []
    for i, t in enumerate(lines):
        if t.startswith("/**"):
            inside = True
            continue
        if inside:
            inside = "*/" not in t
            continue
        if t.startswith(("//", "*", "@Override", "package", "import", "{")):
            continue
        if not re.search(r"public\s+\w+\s+\w+\s*\(", t, re.A):
            continue
        found = False
        for p in reversed(lines[max(0, i - 5):i]):
            if p.startswith("/**"):
                found = True
                break
            if p.startswith(("public", "private", "protected", "class", "interface", "@interface", "enum")):
                break
        if not found:
            hits.append((i + 1, method_name(t)))
    return hits


def method_length(text):
    start, depth, hits = None, 0, []
    lines = text.split("\n")
    for i, line in enumerate(lines):
        t = trim(line)
        if start is None and re.fullmatch(r"(?!(if|while|for|switch|catch|synchronized)\b)\w+.*\(.*\).*\{", t, re.A):
            start, depth = i, 0
        depth += line.count("{") - line.count("}")
        if start is not None and depth <= 0:
            if i - start > 50:
                hits.append((start + 1, i - start))
            start = None
    return hits


def empty_catch(text, repeated=False):
    n_lines = text.count("\n") + 1
    out = []
    for m in re.finditer(r"catch\s*\([^)]*\)\s*\{\s*\}", text, re.A):
        copies = n_lines - text[: m.end()].count("\n") if repeated else 1
        out += [text[: m.start()].count("\n")] * copies
    return out


def void_return(text):
    out = []
    for m in re.finditer(r"(?m)^[+\- ]?\s*return\s+([^;]+)\s*;\s*$", text, re.A):
        before = text[: m.start()]
        decls = list(re.finditer(r"[+\- ]?(?:public|private|protected|static|\s)\s+void\s+\w+\s*\(", before, re.A))
        if decls:
            body = before[decls[-1].start():]
            if body.count("{") > body.count("}"):
                out.append((before.count("\n") + 1, trim(m.group(1))))
    return out


def resource_leak(text):
    kinds = "FileInputStream|FileOutputStream|FileReader|FileWriter|BufferedReader|BufferedWriter"
    out = []
    for m in re.finditer(rf"new\s+({kinds})\s*\(", text, re.A):
        window = text[max(0, m.start() - 200): m.start()]
        at = window.rfind("try")
        if at < 0 or not re.fullmatch(r"try\s*\([^)]*", window[at:], re.A):
            out.append(text[: m.start()].count("\n") + 1)
    return out


def magic_number(text):
    out = []
    for i, line in enumerate(text.split("\n")):
        if trim(line).startswith(("//", "*", "/*", "package", "import", "@")):
            continue
        m = re.search(r"[\s(=,]+(\d{2,}|\d+\.\d+)(?!\s*[.\w])", line, re.A)
        if not m:
            continue
        n = m.group(1)
        # The size test must cover the whole line, which a carriage return prevents.
        size = "\r" not in line and re.search(rf"new\s+\w+\s*\[{re.escape(n)}\]", line, re.A)
        if n in ("0", "1", "-1", "0.0", "1.0", "-1.0") or size:
            continue
        out.append((i + 1, n))
    return out


def empty_block(text):
    out = []
    for pattern in (r"if\s*\([^)]*\)\s*\{\s*\}", r"else\s*\{\s*\}"):
        out += [text[: m.start()].count("\n") + 1 for m in re.finditer(pattern, text, re.A)]
    return out


def indentation(text):
    for i, line in enumerate(text.split("\n")):
        if re.search(r"^(?=\t+\s| +\t).*\S", line, re.A):
            return [i + 1]
    return []


def sticky(rows, threshold=0.7):
    """(total, accepted, dismissed, flag) of feedback verbs in order."""
    total = accepted = dismissed = 0
    flag = False
    for verb in rows:
        total += 1
        accepted += verb == "ACCEPTED"
        dismissed += verb == "DISMISSED"
        if verb == "DISMISSED" and dismissed / total > threshold:
            flag = True
    return total, accepted, dismissed, flag

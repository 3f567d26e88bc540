"""The corpus operators' results by plain Python, written apart from them."""

import hashlib
import math
import re
from collections import defaultdict
from datetime import date, timedelta


class Ppm:
    """Prediction by partial matching, by dictionaries, one symbol at a time."""

    END = 10

    def __init__(self, texts, order):
        self.order = order
        self.counts = [defaultdict(lambda: defaultdict(int)) for _ in range(order + 1)]
        for t in texts:
            for history, symbol in self._steps(t):
                for j in range(order + 1):
                    self.counts[j][history[order - j :]][symbol] += 1
        self.totals = [{c: sum(s.values()) for c, s in level.items()} for level in self.counts]
        self.new = [self._escapes(level) for level in self.counts]

    def _steps(self, text):
        padded = bytes([self.END]) * self.order + text + bytes([self.END])
        for k in range(self.order, len(padded)):
            yield padded[k - self.order : k], padded[k]

    @staticmethod
    def _bucket(total, kinds):
        def step(x):
            return x if x <= 4 else 4 + math.ceil(3 * math.log2(x / 4))

        return step(total), min(step(kinds), 31)

    def _escapes(self, level):
        fresh, known = defaultdict(int), defaultdict(int)
        for symbols in level.values():
            total, kinds, once = sum(symbols.values()), len(symbols), sum(n == 1 for n in symbols.values())
            if total > 1:
                fresh[self._bucket(total - 1, kinds - 1)] += once
                known[self._bucket(total - 1, kinds)] += total - once
        out = {}
        for context, symbols in level.items():
            total, kinds = sum(symbols.values()), len(symbols)
            b = self._bucket(total, kinds)
            out[context] = 0.0 if kinds >= 256 else (fresh[b] + kinds / (2 * total)) / (fresh[b] + known[b] + 1)
        return out

    def chance(self, history, symbol):
        p, excluded = 0.0, set()
        for j in range(self.order, -1, -1):
            context = history[self.order - j :]
            symbols = self.counts[j].get(context)
            if not symbols:
                continue
            new, total = self.new[j][context], self.totals[j][context]
            rest = sum((1 - new) * n / total for s, n in symbols.items() if s not in excluded) + new
            if symbol in symbols:
                return p + math.log10((1 - new) * symbols[symbol] / total / rest)
            p += math.log10(max(new / rest, 1e-300))
            excluded = set(symbols)
        return p - math.log10(max(256 - len(excluded), 1))

    def score(self, text):
        return sum(self.chance(h, s) for h, s in self._steps(text))


def _hash(*parts):
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def _pair(key, kind, a, b, m, n):
    for r in range(8):
        f = int(_hash(key, kind, r, b if r % 2 == 0 else a)[:15], 16)
        a, b = ((a + f) % m, b) if r % 2 == 0 else (a, (b + f) % n)
    return a, b


def _letters(key, kind, value):
    halves = [value[: len(value) // 2], value[len(value) // 2 :]]
    for r in range(8):
        h = _hash(key, kind, r, halves[1 - r % 2])
        moved = ""
        for i, c in enumerate(halves[r % 2]):
            by = int(h[i % 16 * 4 : i % 16 * 4 + 4], 16)
            for low, size in (("0", 10), ("A", 26), ("a", 26)):
                if 0 <= ord(c) - ord(low) < size:
                    c = chr(ord(low) + (ord(c) - ord(low) + by) % size)
                    break
            moved += c
        halves[r % 2] = moved
    return halves[0] + halves[1]


def _put(m, digits):
    left = iter(digits)
    return "".join(next(left) if c in "0123456789" else c for c in m)


def _luhn(digits):
    each = [int(c) for c in reversed(digits)]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(each)) % 10


def _rest97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


_FIRST, _DAYS = date(1850, 1, 1), 324 * 324


def _other_day(key, day):
    a, b = _pair(key, "date", day // 324, day % 324, 324, 324)
    return a * 324 + b


def _dates(key, m):
    shapes = ((r"(\d{4})-(\d\d)-(\d\d)", "%Y-%m-%d", "ymd"), (r"(\d\d)/(\d\d)/(\d{4})", "%d/%m/%Y", "dmy"), (r"(\d\d)\.(\d\d)\.(\d{4})", "%d.%m.%Y", "dmy"), (r"(\d\d)/(\d\d)/(\d{4})", "%m/%d/%Y", "mdy"))
    for shape, form, order in shapes:
        if not (found := re.fullmatch(shape, m)):
            continue
        part = dict(zip(order, map(int, found.groups())))
        try:
            day = (date(part["y"], part["m"], part["d"]) - _FIRST).days
        except ValueError:
            continue
        if not 0 <= day < _DAYS:
            return None
        day = _other_day(key, day)
        while order == "mdy" and (_FIRST + timedelta(day)).day <= 12:
            day = _other_day(key, day)
        return (_FIRST + timedelta(day)).strftime(form)
    return None


def _valid(key, kind, m):
    """The pseudonym of a valid value of this kind, or None."""
    digits = re.sub("[^0-9]", "", m)
    if kind == "email":
        name = m[: m.index("@")]
        return _letters(key, "email", name) + m[len(name) :]
    if kind == "iban":
        plain = m.replace(" ", "")
        if not 15 <= len(plain) <= 34 or _rest97(plain[4:] + plain[:4]) != 1:
            return None
        new = _put(plain[4:], _letters(key, "iban", re.sub("[^0-9]", "", plain[4:])))
        return _put(m, f"{98 - _rest97(new + plain[:2] + '00'):02d}" + re.sub("[^0-9]", "", new))
    if kind == "ip":
        o = [int(x) for x in m.split(".")]
        if max(o) > 255:
            return None
        a, b = _pair(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if kind == "date":
        return _dates(key, m)
    if kind == "ssn":
        area, group, serial = map(int, m.split("-"))
        if not (1 <= area <= 899 and area != 666 and group and serial):
            return None
        a, b = _pair(key, "ssn", (area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999)
        area = a // 99
        return f"{area + 1 + (area > 664):03d}-{a % 99 + 1:02d}-{b + 1:04d}"
    if kind == "nanp":
        head, ten = digits[:-10], digits[-10:]
        plus = m.startswith("+")
        if not (head == "" and not plus or head == "001" or head == "1" and (plus or m[1] not in "0123456789")):
            return None
        if int(ten[:3]) < 200 or int(ten[3:6]) < 200:
            return None
        a, b = _pair(key, "nanp", (int(ten[:3]) - 200) * 800 + int(ten[3:6]) - 200, int(ten[6:]), 640_000, 10_000)
        return _put(m, f"{head}{a // 800 + 200:03d}{a % 800 + 200:03d}{b:04d}")
    if kind == "phone":
        zeros = "00" if m.startswith("00") else ""
        digits = digits[len(zeros) :]
        code = digits[:1] if digits[0] in "17" else digits[:2] if int(digits[:2]) in TWO else digits[:3]
        return _put(m, zeros + code + _letters(key, "phone", digits[len(code) :])) if 7 <= len(digits) <= 15 else None
    if kind == "trunk":
        return _put(m, digits[:2] + _letters(key, "trunk", digits[2:])) if 8 <= len(digits) <= 14 else None
    if _luhn(digits):
        return None
    new = _letters(key, "card", digits[:-1])
    return _put(m, new + str(-_luhn(new + "0") % 10))


# the country codes of two digits, by their zones
TWO = {20, 27, 30, 31, 32, 33, 34, 36, 39, *range(40, 50), *range(51, 59), *range(60, 67), 81, 82, 84, 86, *range(90, 96), 98} - {42}

D = "[0-9]"
GAP = "[ -]"
#: What a value of each kind looks like where it stands alone, in words of its own:
#: (kind, what must not stand before, the value, what must not stand after).
LOOKS = [
    ("email", r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", None),
    ("iban", r"[A-Za-z0-9]", rf"[A-Z]{{2}}{D}{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?", r"[A-Za-z0-9]"),
    ("phone", r"[0-9+]", rf"\+{D}{{1,3}}[ .-]?\(?{D}{{1,4}}\)?(?:[ .-]?{D}{{2,4}})+", D),
    ("ip", r"[0-9.]", rf"{D}{{1,3}}(?:\.{D}{{1,3}}){{3}}", rf"{D}|\.{D}"),
    ("date", r"[0-9./-]", rf"(?:{D}{{4}}-{D}{{2}}-{D}{{2}}|{D}{{2}}/{D}{{2}}/{D}{{4}}|{D}{{2}}\.{D}{{2}}\.{D}{{4}})", r"[0-9/-]"),
    ("ssn", r"[0-9-]", rf"{D}{{3}}-{D}{{2}}-{D}{{4}}", r"[0-9-]"),
    ("nanp", r"[0-9+-]", rf"(?:1[ .-])?(?:\({D}{{3}}\) ?|{D}{{3}}[.-]){D}{{3}}[.-]{D}{{4}}", r"[0-9-]"),
    ("phone", r"[0-9.,/+-]", rf"00[1-9]{D}{{0,2}}{GAP}\(?{D}{{1,4}}\)?(?:{GAP}?{D}{{2,4}}){{2,}}", rf"{D}|[.,/-]{D}"),
    ("trunk", r"[0-9.,/+-]", rf"\(?0[1-9]{D}{{1,4}}(?:\) ?|[ /-]){D}{{3,8}}(?:{GAP}{D}{{2,4}})*", rf"{D}|[.,/-]{D}"),
    ("card", D, rf"{D}(?:{GAP}?{D}){{12,}}", None),
]
FIND = re.compile("|".join((f"(?<!{before})" if before else "") + f"(?:{look})" + (f"(?!{after})" if after else "") for _, before, look, after in LOOKS), re.A)
CARD = rf"{D}{{13,19}}|[2-9]{D}{{3}}({GAP}){D}{{4}}\1{D}{{4}}\1{D}{{1,4}}(?:\1{D}{{1,3}})?|3{D}{{3}}({GAP}){D}{{6}}\2{D}{{4,5}}"


def _alone(key, m):
    """(kind, pseudonym) of a whole candidate."""
    def is_(pattern):
        return re.fullmatch(pattern, m, re.A)

    tried = [
        ("email", "@" in m), ("iban", re.match(r"[A-Z]{2}[0-9]{2}", m)), ("ip", is_(rf"{D}{{1,3}}(?:\.{D}{{1,3}}){{3}}")),
        ("date", is_(rf"{D}{{4}}-{D}{{2}}-{D}{{2}}|{D}{{2}}([./]){D}{{2}}\1{D}{{4}}")), ("ssn", is_(rf"{D}{{3}}-{D}{{2}}-{D}{{4}}")),
        ("nanp", is_(rf"(?:(?:\+|00)?1[ .-]?)?\(?{D}{{3}}\)?[ .-]?{D}{{3}}[. -]?{D}{{4}}")), ("phone", is_(r"(?:\+|00[1-9][0-9]{0,2}[ -])[0-9 .()-]+")),
        ("trunk", is_(rf"\(?0[1-9]{D}{{1,4}}(?:\) ?|[ /-])[0-9 -]+")), ("card", is_(rf"{D}(?:{GAP}?{D}){{12,18}}")),
    ]
    return next(((k, new) for k, fits in tried if fits and (new := _valid(key, k, m)) is not None), None)


def _part(key, m):
    """(kind, pseudonym) of some groups of a candidate, in the usual groupings."""
    def is_(pattern):
        return re.fullmatch(pattern, m, re.A)

    tried = [
        ("iban", is_(LOOKS[1][2])), ("date", is_(rf"{D}{{4}}-{D}{{2}}-{D}{{2}}")), ("ssn", is_(rf"{D}{{3}}-{D}{{2}}-{D}{{4}}")),
        ("nanp", is_(rf"(?:\+|00)1{GAP}\(?{D}{{3}}\)?{GAP}?{D}{{3}}{GAP}?{D}{{4}}") or is_(rf"(?:1{GAP})?(?:\({D}{{3}}\) |{D}{{3}}-){D}{{3}}-{D}{{4}}")),
        ("phone", is_(rf"\+{D}{{1,3}}{GAP}?\(?{D}{{1,4}}\)?(?:{GAP}?{D}{{2,4}}){{1,4}}") or is_(rf"00[1-9]{D}{{0,2}}{GAP}\(?{D}{{1,4}}\)?(?:{GAP}?{D}{{2,4}}){{2,4}}")),
        ("trunk", is_(rf"\(?0[1-9]{D}{{1,4}}(?:\) |{GAP}){D}{{3,8}}(?:{GAP}{D}{{2,4}}){{0,3}}")), ("card", is_(CARD)),
    ]
    return next(((k, new) for k, fits in tried if fits and (new := _valid(key, k, m)) is not None), None)


def pseudonyms(text, key):
    """The text with pseudonyms, and the kinds found."""
    kinds = []

    def taken(found):
        kinds.append("phone" if found[0] == "trunk" else found[0])
        return found[1]

    def swap(match):
        m = match[0]
        if found := _alone(key, m):
            return taken(found)
        if "@" in m or not re.search(GAP, m):
            return m
        like_card = re.fullmatch(CARD, m, re.A)
        groups, out, g = re.findall(r"[^ -]*[ -]|[^ -]+", m), "", 0
        while g < len(groups):
            for h in range(min(len(groups), g + 9), g, -1):
                whole = "".join(groups[g:h])
                bare = whole[:-1] if whole[-1] in " -" else whole
                found = _part(key, bare)
                if found and not (like_card and found[0] not in ("card", "iban")):
                    out, g = out + taken(found) + whole[len(bare) :], h
                    break
            else:
                out, g = out + groups[g], g + 1
        return out

    return (None, []) if text is None else (FIND.sub(swap, text), kinds)


def _common(a, b, x, y, to_x, to_y):
    """Patience diff by recursion: index pairs."""
    head = []
    while x < to_x and y < to_y and a[x] == b[y]:
        head.append((x, y))
        x, y = x + 1, y + 1
    tail = []
    while x < to_x and y < to_y and a[to_x - 1] == b[to_y - 1]:
        to_x, to_y = to_x - 1, to_y - 1
        tail.insert(0, (to_x, to_y))
    at_b = {t: k for k, t in enumerate(b[y:to_y], y) if b[y:to_y].count(t) == 1} if x < to_x and y < to_y else {}
    unique = [(k, at_b[t]) for k, t in enumerate(a[x:to_x], x) if t in at_b and a[x:to_x].count(t) == 1]
    best = []  # the longest rising run that ends at each
    for k, (i, j) in enumerate(unique):
        before = max((best[p] for p in range(k) if unique[p][1] < j), key=len, default=[])
        best.append([*before, (i, j)])
    middle, anchors = [], max(best, key=len, default=[])
    for i, j in [*anchors, (to_x, to_y)] if anchors else []:
        middle += _common(a, b, x, y, i, j)
        if (i, j) != (to_x, to_y):
            middle.append((i, j))
        x, y = i + 1, j + 1
    return head + middle + tail


def line_dedup(texts, least):
    """For each document the lines that aligned blocks with any earlier one cover."""
    gone, heads = {}, {}
    for i in sorted(texts):
        text = texts[i] if texts[i] is not None else ""
        own = text.split("\n")
        if text in heads.values():
            gone[i] = set(range(len(own))) if len(text) >= least else set()
            continue
        gone[i] = set()
        for before in heads.values():
            other = before.split("\n")
            if not set(own) & set(other) - {""}:
                continue
            block = []
            for pair in [*_common(own, other, 0, 0, len(own), len(other)), (-9, -9)]:
                if block and pair != (block[-1][0] + 1, block[-1][1] + 1):
                    if sum(len(own[k].strip(" ")) for k, _ in block) >= least:
                        gone[i] |= {k for k, _ in block}
                    block = []
                block.append(pair)
        heads[i] = text
    return gone


def near_links(texts, similarity):
    """For each document the smallest id that links of near copies lead to."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        if w:
            sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    least = {i: i for i in texts}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                a, b = root(i), root(j)
                least[max(a, b)] = min(a, b)
    return {i: root(i) for i in texts}

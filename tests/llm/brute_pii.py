"""The pseudonyms again, in plain Python: one value at a time, from the descriptions in the operator's docstrings."""

import datetime
import hashlib

import regex

from tallyloom.llm import pii

ONE = {"iban": pii.IBAN, "card": pii.CARD}
PLAIN = regex.compile(f"(?:{pii.DATE}|{pii.SSN}|{pii.LOCAL_PHONE}|{pii.ACCESS_KEY})")


def sha(*parts):
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def turned(tweak, moved, *other):
    seed = sha(pii.KEY, tweak, *other, len(moved))
    out = []
    for i, c in enumerate(moved):
        by = int(sha(seed, i // 16)[4 * (i % 16) : 4 * (i % 16) + 4], 16)
        first, n = (48, 10) if "0" <= c <= "9" else (97, 26) if "a" <= c <= "z" else (65, 26) if "A" <= c <= "Z" else (None, 0)
        out.append(chr(first + (ord(c) - first + by) % n) if first else c)
    return "".join(out)


def feistel(value, kind):
    a, b = value[: len(value) // 2], value[len(value) // 2 :]
    for r in range(1, pii.ROUNDS + 1):
        if r % 2 == 0:
            a = turned(f"{kind}a", a, r, b)
        else:
            b = turned(f"{kind}b", b, r, a)
    return a + b


def number(value, left, right, kind):
    a, b = divmod(value, right)
    for r in range(1, pii.ROUNDS + 1):
        if r % 2 == 0:
            a = (a + int(sha(pii.KEY, kind + "a", r, b)[:12], 16)) % left
        else:
            b = (b + int(sha(pii.KEY, kind + "b", r, a)[:12], 16)) % right
    return a * right + b


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10


def mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def day(y, m, d):
    try:
        return datetime.date(int(y), int(m), int(d)) if "1000" <= y <= "9799" else None
    except ValueError:
        return None


def kind(v):
    plain = v.replace(" ", "").replace("-", "")
    if regex.match(pii.PASSWORD_IS, v):
        return "password"
    if "@" in v:
        return "email"
    if regex.fullmatch("(AKIA|ASIA)[A-Z0-9]{16}", v):
        return "access_key"
    if regex.match("[A-Z]{2}[0-9]{2}", v):
        return "iban" if 15 <= len(plain) <= 34 and mod97(plain) == 1 else None
    if regex.fullmatch("[0-9]{4}-[0-9]{2}-[0-9]{2}", v):
        return "date" if day(v[:4], v[5:7], v[8:]) else None
    if regex.fullmatch("[0-9]{2}[/.][0-9]{2}[/.][0-9]{4}", v):
        return "date_dmy" if day(v[6:], v[3:5], v[:2]) else "date_mdy" if day(v[6:], v[:2], v[3:5]) else None
    if regex.fullmatch(r"([0-9]{1,3}\.){3}[0-9]{1,3}", v):
        return "ip" if all(int(o) < 256 for o in v.split(".")) else None
    if regex.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", v):
        return "ssn" if v[:3] not in ("000", "666") and v[0] != "9" and v[4:6] != "00" and v[7:] != "0000" else None
    if regex.fullmatch("[0-9][0-9 -]*", v) and 13 <= len(plain) <= 19 and luhn(plain) == 0:
        return "card"
    if regex.match(r"[+(]|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$", v) and 8 <= sum(c.isdigit() for c in v) <= 15:
        return "phone"
    return None


def refilled(shape, signs):
    signs = iter(signs)
    return "".join(next(signs) if c.isascii() and c.isalnum() else c for c in shape)


def pseudonym(v, k):
    plain = v.replace(" ", "").replace("-", "")
    if k == "email":
        local, domain = v.rsplit("@", 1)
        site, end = domain.rsplit(".", 1)
        return f"{feistel(local, 'email')}@{feistel(site, 'domain')}.{end}"
    if k == "access_key":
        return v[:4] + feistel(v[4:], "key")
    if k == "iban":
        account = feistel(plain[4:], "iban")
        return refilled(v, f"{plain[:2]}{98 - mod97(plain[:2] + '00' + account):02}{account}")
    if k in ("date", "date_dmy", "date_mdy"):
        y, m, d = (v[:4], v[5:7], v[8:]) if k == "date" else (v[6:], v[3:5], v[:2]) if k == "date_dmy" else (v[6:], v[:2], v[3:5])
        span, at = divmod((day(y, m, d) - datetime.date(1900, 1, 1)).days, 73000)
        new = datetime.date(1900, 1, 1) + datetime.timedelta(span * 73000 + number(at, 250, 292, "date"))
        y, m, d = f"{new.year:04}", f"{new.month:02}", f"{new.day:02}"
        return f"{y}-{m}-{d}" if k == "date" else v[2].join((d, m, y) if k == "date_dmy" else (m, d, y))
    if k == "ip":
        n = number(sum(int(o) << 8 * (3 - i) for i, o in enumerate(v.split("."))), 65536, 65536, "ip")
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if k == "ssn":
        areas = [a for a in range(1, 900) if a != 666]
        n = number((areas.index(int(v[:3])) * 99 + int(v[4:6]) - 1) * 9999 + int(v[7:]) - 1, 898 * 99, 9999, "ssn")
        return f"{areas[n // 9999 // 99]:03}-{n // 9999 % 99 + 1:02}-{n % 9999 + 1:04}"
    if k == "card":
        body = feistel(plain[:-1], "card")
        return refilled(v, body + next(str(c) for c in range(10) if luhn(f"{body}{c}") == 0))
    if k == "phone":
        digits = "".join(c for c in v if c.isdigit())
        code = len(regex.match(pii.COUNTRY, digits)[0]) if v[0] == "+" else 0
        return refilled(v, digits[:code] + feistel(digits[code:], "phone"))
    if k == "password":
        at = len(regex.match(pii.PASSWORD_IS + "[\"']?", v)[0])
        return v[:at] + feistel(v[at:], "password")
    return v


def within(v):
    """The confirmed values in a match that is none itself."""
    t, out, i = regex.findall("[0-9A-Za-z]+|[^0-9A-Za-z]+", v), [], 0
    while i < len(t):
        best = None
        for e in range(min(len(t), i + 37), i, -1):
            run = "".join(t[i:e])
            if not 8 <= len(run) <= 42 or not regex.search("[0-9A-Z]", t[i]) or not regex.search("[0-9A-Z]", t[e - 1]):
                continue
            k = kind(run)
            near = (t[i - 1] if i else "") + (t[e] if e < len(t) else "")
            if k == "iban":
                ok = regex.fullmatch(pii.IBAN, run)
            elif k == "card":
                more = e + 1 < len(t) and regex.fullmatch(pii.CARD, run + t[e] + t[e + 1])
                ok = regex.fullmatch(pii.PRINTED, run) or regex.fullmatch(pii.CARD, run) and not more
            else:
                ok = k and PLAIN.fullmatch(run) and not regex.search("[./-]", near)
            if ok:
                best = (run, k, e)
                break
        out.append(best[:2] if best else (t[i], None))
        i = best[2] if best else i + 1
    return out


def pseudonymised(text):
    """New text, number of findings and their kinds."""
    if text is None:
        return None, 0, ""
    kinds = []

    def one(m):
        v = m[0]
        k = kind(v)
        found = [(v, k)] if k or len(v) < 13 else within(v)
        kinds.extend(k for _, k in found if k)
        return "".join(pseudonym(x, k) for x, k in found)

    return regex.sub(pii.PATTERN, one, text), len(kinds), ",".join(sorted(set(kinds)))

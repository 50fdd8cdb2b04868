"""Format-preserving pseudonyms for personal data, in SQL expressions only.

A value that a pattern finds and a check confirms (Luhn for cards, mod 97 for IBANs, the calendar for dates, octets for addresses, the ranges of social
security numbers) is replaced by a keyed Feistel permutation of its own format: digits stay digits, letters stay letters of their case, everything else
stays where it stands, a card still passes Luhn, an IBAN its check digits, a date is a date, a valid number a valid number. What follows password= is
replaced up to the next blank, quote or &, at any length. The permutation depends on the key, the kind and the value alone (of a phone: its national
number, so signs and country code don't unlink it), so equal values stay linked across all documents and different ones stay different.

Null texts stay null and empty ones empty, both with no findings. Repeated rows get equal results. Other columns stay as they are, also those that have
the name of an added one, and so do rows without findings. All work is done within the scan, row by row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import documents, fresh

#: Patterns, tried from left to right at each place.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,24}(?![A-Za-z0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,15}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
ACCESS_KEY = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
#: The word that names a secret; what follows is one whatever it looks like.
PASSWORD_IS = r"(?i:password|passwd|pwd)="
PASSWORD = rf"{PASSWORD_IS}[\"']?[^\s\"'&]+"
DATE = r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9A-Za-z/-])"
IP = r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
CARD = r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"
#: The whole run of digit groups that a card may be in, but for a last group that begins an address or date; pieces() looks for what is in it.
RUN = r"(?<![0-9A-Za-z])[0-9](?=(?:[ -]?[0-9]){12})[0-9 -]*(?<=[0-9])(?![0-9A-Za-z])(?!(?<=[ -][0-9]{1,3})\.[0-9]|(?<=[ -][0-9]{2})/[0-9])"
#: Cards as they are printed: digits without a break, by fours, or 4, 6 and 4 or 5.
PRINTED = r"[0-9]{13,19}|[0-9]{4}([ -])(?:[0-9]{4}\1){2}(?:[0-9]{1,4}|[0-9]{4}\1[0-9]{1,3})|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5}"
#: A further group of a phone's digits: none that another value begins at, and none that makes them more than 15.
GROUP = rf"(?!{IP}|{DATE}|{SSN}|[0-9]{{4}}(?:[ -]?[0-9]{{4}}){{3}}(?![ -]?[0-9A-Za-z]))[0-9]{{2,4}}(?<!{'[0-9][ .()-]{0,2}' * 15}[0-9])"
LOCAL_PHONE = r"[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}"
PHONE = rf"(?<![0-9A-Za-z])(?:\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,4}}\)[ .-]?)?{GROUP}(?:[ .-]?{GROUP}){{1,4}}|\([0-9]{{3}}\)[ .-]?[0-9]{{3}}[.-][0-9]{{4}}|{LOCAL_PHONE})(?![0-9A-Za-z])"
#: The country codes of E.164, those of three digits being all others.
COUNTRY = "^(?:1|7|2[07]|3[0-4]|36|39|4[0-1]|4[3-9]|5[1-8]|6[0-6]|8[1246]|9[0-5]|98|[0-9]{3})"
PATTERN = "|".join((EMAIL, IBAN, ACCESS_KEY, PASSWORD, DATE, IP, SSN, PHONE, RUN))

ROUNDS = 6
KEY = "tallyloom"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """body, a SQL expression in which `name` stands for value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _number(key: str, tweak: str, value: str, width: int = 12) -> str:
    """A keyed pseudo-random number from a SQL string expression."""
    return f"cast(conv(substr(sha2(concat_ws('|', {_sql(key)}, '{tweak}', {value}), 256), 1, {width}), 16, 10) as bigint)"


def _shift(key: str, tweak: str, moved: str, other: str) -> str:
    """moved with each letter and digit shifted within its class by a keyed stream that depends on the other half, the length and the place.

    The other half is hashed once and the stream from that hash, sixteen places a block, so the work grows with the length alone.
    """
    seed = f"sha2(concat_ws('|', {_sql(key)}, '{tweak}', {other}, cast(length({moved}) as string)), 256)"
    by = "cast(conv(substr(sha2(concat(h, '|', cast(i div 16 as string)), 256), cast(1 + 4 * (i % 16) as int), 4), 16, 10) as int)"

    def turn(first: int, n: int) -> str:
        return f"chr({first} + pmod(ascii(c) - {first} + {by}, {n}))"

    body = f"case when c between '0' and '9' then {turn(48, 10)} when c between 'a' and 'z' then {turn(97, 26)} when c between 'A' and 'Z' then {turn(65, 26)} else c end"
    return _let("h", seed, f"array_join(transform(split({moved}, ''), (c, i) -> {body}), '')")


def feistel_text(value: str, key: str, kind: str) -> str:
    """A permutation of strings that keeps each character's class: two halves shift each other in turn.

    The state is a struct of the halves, folded over the rounds, so each round's expression stands once.
    """
    start = f"named_struct('a', substr({value}, 1, cast(length({value}) div 2 as int)), 'b', substr({value}, cast(length({value}) div 2 as int) + 1))"
    a = _shift(key, f"{kind}a", "s.a", "concat_ws('|', cast(r as string), s.b)")
    b = _shift(key, f"{kind}b", "s.b", "concat_ws('|', cast(r as string), s.a)")
    step = f"case when r % 2 = 0 then named_struct('a', {a}, 'b', s.b) else named_struct('a', s.a, 'b', {b}) end"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> {step}, s -> concat(s.a, s.b))"


def feistel_number(value: str, left: int, right: int, key: str, kind: str) -> str:
    """A permutation of 0 .. left * right - 1."""
    start = f"named_struct('a', cast({value} div {right} as bigint), 'b', cast({value} % {right} as bigint))"
    mixed_a = f"pmod(s.a + {_number(key, kind + 'a', "cast(r as string), cast(s.b as string)")}, {left})"
    mixed_b = f"pmod(s.b + {_number(key, kind + 'b', "cast(r as string), cast(s.a as string)")}, {right})"
    step = f"case when r % 2 = 0 then named_struct('a', {mixed_a}, 'b', s.b) else named_struct('a', s.a, 'b', {mixed_b}) end"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> {step}, s -> s.a * {right} + s.b)"


def _luhn_sum(digits: str, double_last: bool) -> str:
    """The Luhn sum of a digit string, its last digit doubled or not."""
    at = f"cast(substr({digits}, length({digits}) - k, 1) as int)"
    twice = "k % 2 = 0" if double_last else "k % 2 = 1"
    return f"aggregate(sequence(0, length({digits}) - 1), 0L, (n, k) -> n + case when {twice} then (2 * {at}) div 10 + (2 * {at}) % 10 else {at} end)"


def _refill(shape: str, digits: str) -> str:
    """shape with its letters and digits replaced in turn by those of `digits`; separators stay."""
    return f"array_join(zip_with(split({shape}, '[A-Za-z0-9]'), split({digits}, ''), (p, d) -> concat(coalesce(p, ''), coalesce(d, ''))), '')"


def _mod97(text: str) -> str:
    """An IBAN's remainder: country and check digits last, letters as 10 to 35."""
    turned = f"concat(substr({text}, 5), substr({text}, 1, 4))"
    code = f"ascii(substr({turned}, k + 1, 1))"
    return f"cast(aggregate(sequence(0, length({text}) - 1), 0, (n, k) -> case when {code} >= 65 then (n * 100 + {code} - 55) % 97 else (n * 10 + {code} - 48) % 97 end) as int)"


def _date(value: str, day: str, month: str, year: str, back: str, key: str) -> str:
    """Days are permuted within spans of 73,000 days (near 200 years) from 1900 on; back: the format."""
    number = f"datediff(try_to_date(concat({year}, '-', {month}, '-', {day}), 'yyyy-MM-dd'), date'1900-01-01')"
    base = f"cast(floor({number} / 73000D) as int)"
    moved = feistel_number(f"cast(pmod({number}, 73000) as bigint)", 250, 292, key, "date")
    return f"date_format(date_add(date'1900-01-01', cast({base} * 73000 + {moved} as int)), '{back}')"


def _ssn(value: str, key: str) -> str:
    """The number's rank among the valid ones (areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999) is permuted, so only valid ones come out."""
    area, group, serial = (f"cast(substr({value}, {at}, {n}) as bigint)" for at, n in ((1, 3), (5, 2), (8, 4)))
    rank = f"((({area} - case when {area} > 666 then 2 else 1 end) * 99 + {group} - 1) * 9999 + {serial} - 1)"
    moved = feistel_number(rank, 898 * 99, 9999, key, "ssn")
    place = "n div 989901"
    return _let("n", moved, f"concat(lpad(cast({place} + case when {place} >= 665 then 2 else 1 end as string), 3, '0'), '-', lpad(cast(n div 9999 % 99 + 1 as string), 2, '0'), '-', lpad(cast(n % 9999 + 1 as string), 4, '0'))")


def _valid_date(day: str, month: str, year: str) -> str:
    return f"try_to_date(concat({year}, '-', {month}, '-', {day}), 'yyyy-MM-dd') is not null and {year} between '1000' and '9799'"


def kind_of(value: str) -> str:
    """Which validated kind a matched string is; null where no check confirms it.

    The alternatives' formats exclude each other: what follows password= is a password whatever it looks like, for no other format begins so.
    """
    plain = f"regexp_replace({value}, '[ -]', '')"
    iso = _valid_date(f"substr({value}, 9, 2)", f"substr({value}, 6, 2)", f"substr({value}, 1, 4)")
    day_first = _valid_date(f"substr({value}, 1, 2)", f"substr({value}, 4, 2)", f"substr({value}, 7, 4)")
    month_first = _valid_date(f"substr({value}, 4, 2)", f"substr({value}, 1, 2)", f"substr({value}, 7, 4)")
    ssn = f"substr({value}, 1, 3) not in ('000', '666') and {value} < '9' and substr({value}, 5, 2) <> '00' and substr({value}, 8, 4) <> '0000'"
    return f"""case
        when {value} rlike {_sql(f'^{PASSWORD_IS}')} then 'password'
        when {value} like '%@%' then 'email'
        when {value} rlike '^(AKIA|ASIA)[A-Z0-9]{{16}}$' then 'access_key'
        when {value} rlike '^[A-Z]{{2}}[0-9]{{2}}' and length({plain}) between 15 and 34 and {_mod97(plain)} = 1 then 'iban'
        when {value} rlike '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' then case when {iso} then 'date' end
        when {value} rlike '^[0-9]{{2}}[/.][0-9]{{2}}[/.][0-9]{{4}}$' then case when {day_first} then 'date_dmy' when {month_first} then 'date_mdy' end
        when {value} rlike '^([0-9]{{1,3}}[.]){{3}}[0-9]{{1,3}}$' then case when forall(split({value}, '[.]'), o -> cast(o as int) <= 255) then 'ip' end
        when {value} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then case when {ssn} then 'ssn' end
        when {value} rlike '^[0-9][0-9 -]*$' and length({plain}) between 13 and 19 and {_luhn_sum(plain, False)} % 10 = 0 then 'card'
        when {value} rlike '^[+(]|^[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}}$' and length(regexp_replace({value}, '[^0-9]', '')) between 8 and 15 then 'phone'
        end"""


def pieces(value: str) -> str:
    """What a matched string consists of, as structs of v and k (the kind, or null) that together are the string.

    A match that no check confirms is searched again from each of its groups on: at each the longest run of groups that a check confirms is a value.
    """
    near = "concat(coalesce(get(t, i - 2), ''), coalesce(get(t, c.e), ''))"
    whole_card = f"c.v rlike {_sql(f'^(?:{CARD})$')} and not coalesce(concat(c.v, get(t, c.e), get(t, c.e + 1)) rlike {_sql(f'^(?:{CARD})$')}, false)"
    checked = f"""case
        when c.k = 'iban' then c.v rlike {_sql(f'^(?:{IBAN})$')}
        when c.k = 'card' then c.v rlike {_sql(f'^(?:{PRINTED})$')} or {whole_card}
        when c.k is not null then c.v rlike {_sql(f'^(?:{DATE}|{SSN}|{LOCAL_PHONE}|{ACCESS_KEY})$')} and {near} not rlike '[./-]' end"""
    ends = "filter(sequence(least(size(t), i + 36), i, -1), e -> t[i - 1] rlike '[0-9A-Z]' and t[e - 1] rlike '[0-9A-Z]')"
    runs = f"filter(transform({ends}, e -> named_struct('e', e, 'v', array_join(slice(t, i, e - i + 1), ''))), c -> length(c.v) between 8 and 42)"
    best = f"get(filter(transform({runs}, c -> named_struct('e', c.e, 'v', c.v, 'k', {kind_of('c.v')})), c -> {checked}), 0)"
    found = f"coalesce({best}, named_struct('e', i, 'v', t[i - 1], 'k', cast(null as string)))"
    step = _let("b", found, "named_struct('next', b.e + 1, 'out', concat(s.out, array(named_struct('v', b.v, 'k', b.k))))")
    nothing = "named_struct('next', 1, 'out', cast(array() as array<struct<v: string, k: string>>))"
    fold = f"aggregate(sequence(1, size(t)), {nothing}, (s, i) -> case when i < s.next then s else {step} end, s -> s.out)"
    again = _let("t", f"regexp_extract_all({value}, '[0-9A-Za-z]+|[^0-9A-Za-z]+', 0)", fold)
    return _let("k", kind_of(value), f"case when k is null and length({value}) >= 13 then {again} else array(named_struct('v', {value}, 'k', k)) end")


def pseudonym(value: str, kind: str, key: str) -> str:
    """The pseudonym of a matched string of a kind; the string itself where the kind is null."""
    plain = f"regexp_replace({value}, '[ -]', '')"
    octets = f"split({value}, '[.]')"
    pair = lambda k: f"cast(element_at({octets}, {k}) as bigint) * 256 + cast(element_at({octets}, {k + 1}) as bigint)"
    ip = feistel_number(f"(({pair(1)}) * 65536 + {pair(3)})", 65536, 65536, key, "ip")
    check_digit = f"concat(d, cast(pmod(10 - {_luhn_sum('d', True)} % 10, 10) as string))"
    card = _let("d", feistel_text(f"substr({plain}, 1, length({plain}) - 1)", key, "card"), _refill(value, check_digit))
    with_check = f"concat(substr(d, 1, 2), lpad(cast(98 - {_mod97('d')} as string), 2, '0'), substr(d, 5))"
    account = _let("d", f"concat(substr({plain}, 1, 2), '00', {feistel_text(f'substr({plain}, 5)', key, 'iban')})", _refill(value, with_check))
    digits = f"regexp_replace({value}, '[^0-9]', '')"
    country = f"case when {value} like '+%' then length(regexp_extract({digits}, '{COUNTRY}', 0)) else 0 end"
    phone = _refill(value, f"concat(substr({digits}, 1, {country}), {feistel_text(f'substr({digits}, {country} + 1)', key, 'phone')})")
    local, domain = f"substring_index({value}, '@', 1)", f"substring_index({value}, '@', -1)"
    site = feistel_text(f"regexp_extract({domain}, '^(.*)[.][A-Za-z]+$', 1)", key, "domain")
    iso = _date(value, f"substr({value}, 9, 2)", f"substr({value}, 6, 2)", f"substr({value}, 1, 4)", "yyyy-MM-dd", key)
    day_first = _date(value, f"substr({value}, 1, 2)", f"substr({value}, 4, 2)", f"substr({value}, 7, 4)", "dd/MM/yyyy", key)
    month_first = _date(value, f"substr({value}, 4, 2)", f"substr({value}, 1, 2)", f"substr({value}, 7, 4)", "MM/dd/yyyy", key)
    opening = _sql(f"^{PASSWORD_IS}[\"']?")
    before = f"regexp_extract({value}, {opening}, 0)"
    return f"""case {kind}
        when 'email' then concat({feistel_text(local, key, 'email')}, '@', {site}, '.', substring_index({domain}, '.', -1))
        when 'access_key' then concat(substr({value}, 1, 4), {feistel_text(f'substr({value}, 5)', key, 'key')})
        when 'iban' then {account}
        when 'date' then {iso}
        when 'date_dmy' then replace({day_first}, '/', substr({value}, 3, 1))
        when 'date_mdy' then replace({month_first}, '/', substr({value}, 3, 1))
        when 'ip' then {_let('n', ip, "concat_ws('.', n div 16777216, n div 65536 % 256, n div 256 % 256, n % 256)")}
        when 'ssn' then {_ssn(value, key)}
        when 'card' then {card}
        when 'phone' then {phone}
        when 'password' then concat({before}, {feistel_text(f'substr({value}, length({before}) + 1)', key, 'password')})
        else {value} end"""


def pseudonymise(docs: DataFrame, key: str = KEY, text_col: str = "text", count_col: str = "n_pii", kinds_col: str = "kinds") -> DataFrame:
    """docs with its text's findings replaced, and their number and their kinds (a sorted list of the distinct ones) added.

    A column of docs that has an added name stays as it is; the added one then has underscores behind its name.
    """
    count_col, kinds_col, found_col, new_col = fresh(docs.columns, count_col, kinds_col, "_found", "_new")
    names = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    text = F.col(f"`{text_col}`")
    some = text.rlike(f"[0-9@]|{PASSWORD_IS}")  # no pattern matches without; a cheap look spares most texts the rest
    parts = F.split(text, PATTERN)
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    marked = docs.withColumn(found_col, F.when(some, found))
    marked = marked.withColumn(found_col, F.expr(f"transform({found_col}, v -> {pieces('v')})"))
    marked = marked.withColumn(new_col, F.expr(f"transform({found_col}, p -> array_join(transform(p, f -> {pseudonym('f.v', 'f.k', key)}), ''))"))
    joined = F.array_join(F.zip_with(parts, F.col(new_col), lambda p, v: F.concat(F.coalesce(p, F.lit("")), F.coalesce(v, F.lit("")))), "")
    kinds = F.filter(F.transform(F.flatten(found_col), lambda f: f["k"]), lambda k: k.isNotNull())
    replaced = F.when(F.size(found_col) > 0, joined).otherwise(text).alias(text_col)
    count = F.greatest(F.coalesce(F.size(kinds), F.lit(0)), F.lit(0)).cast("long").alias(count_col)
    listed = F.coalesce(F.array_join(F.array_sort(F.array_distinct(kinds)), ","), F.lit("")).alias(kinds_col)
    at = docs.columns.index(text_col)
    return marked.select(*names[:at], replaced, *names[at:], count, listed)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "text", "n_pii", "kinds")

"""PII: format-preserving pseudonyms from a keyed Feistel network.

Numbers and dates that are valid of their kind are permuted, under a key, among the valid values of the same format: a
card number becomes another one with the same punctuation and a right check digit, a date another day in the same
notation. Equal values get equal pseudonyms in every document, and the key's holder can undo them. What isn't valid of
its kind stays as it is. Of e-mail addresses the letters and digits before the @ are permuted, each within its kind.

A value is split into two numbers, left in [0, a) and right in [0, b), where a * b is the number of valid values; rounds
add a keyed hash of one side to the other, modulo its size. Each round can be undone, so the whole is a permutation of
exactly the valid values, without cycle walking.

The key comes as a column that a scalar subquery fills, so plans and event logs show its name only. DataFrame and SQL
functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.llm.common import boxed
from lodevec.llm.matches import sql_text

#: The kinds and their patterns, in the order in which they are tried at a place.
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "date": r"(?<![0-9.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9-])",
    "ip": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9(+])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[1-9](?:[ .-]?\(?[0-9]\)?){7,14})(?![0-9])",
    "number": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
#: Lengths of IBANs by country.
IBAN_LENGTHS = "AD24AE23AL28AT20AZ28BA20BE16BG22BH22BI27BR29BY28CH21CR22CY28CZ24DE22DJ27DK18DO28EE20EG29ES24FI18FK18FO18FR27GB22GE22GI23GL18GR27GT28HN28HR21HU28IE22IL23IQ23IS26IT27JO30KW30KZ20LB28LC32LI21LT20LU20LV21LY25MC27MD24ME22MK19MN20MR27MT31MU30NI28NL18NO15OM23PK24PL28PS29PT25QA29RO24RS22RU33SA24SC31SD18SE24SI19SK24SM27SO23ST25SV28TL23TN24TR26UA29VA22VG24XK20YE30"
#: Country codes of one and two digits; all others have three.
CODES = "^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
#: Days of the 400 years of the calendar's cycle, 189 * 773, from this day on.
FIRST_DAY, CYCLE_A, CYCLE_B = "1700-01-01", 189, 773


@dataclass(frozen=True)
class PiiParams:
    """key: of the permutation (production passes its own); rounds: of the network."""

    key: str = "lodevec-demonstration-key"
    rounds: int = 10


def feistel(left: str, right: str, a: str, b: str, kind: str, p: PiiParams) -> str:
    """SQL for struct<l, r>: the permuted pair of bigints, left below a and right below b. The key is the column _key."""
    mask = f"cast(conv(substring(sha2(concat_ws(':', _key, {kind}, cast(f.a as string), cast(f.b as string), cast(i as string), cast(if(i % 2 = 0, f.r, f.l) as string)), 256), 1, 15), 16, 10) as bigint)"
    step = f"if(i % 2 = 0, named_struct('l', (f.l + pmod({mask}, f.a)) % f.a, 'r', f.r, 'a', f.a, 'b', f.b), named_struct('l', f.l, 'r', (f.r + pmod({mask}, f.b)) % f.b, 'a', f.a, 'b', f.b))"
    start = ", ".join(f"'{n}', cast({v} as bigint)" for n, v in (("l", left), ("r", right), ("a", a), ("b", b)))
    return f"aggregate(sequence(0, {p.rounds - 1}), named_struct({start}), (f, i) -> {step})"


def let(name: str, value: str, body: str) -> str:
    """SQL for body with value under a name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def digits_of(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9]', '')"


def refilled(text: str, digits: str) -> str:
    """SQL: text with its digits replaced in turn by those of another string."""
    step = f"if(c between '0' and '9', named_struct('o', concat(g.o, substring(g.d, g.n, 1)), 'n', g.n + 1, 'd', g.d), named_struct('o', concat(g.o, c), 'n', g.n, 'd', g.d))"
    return f"aggregate(filter(split({text}, ''), c -> c <> ''), named_struct('o', '', 'n', 1, 'd', {digits}), (g, c) -> {step}, g -> g.o)"


def permuted_digits(digits: str, kind: str, p: PiiParams) -> str:
    """SQL: a string of up to 36 digits permuted among those of its length."""
    half = "cast(floor(length(d) / 2) as int)"
    pair = feistel(f"if({half} = 0, '0', substring(d, 1, {half}))", f"substring(d, {half} + 1)", f"cast(concat('1', repeat('0', {half})) as bigint)", f"cast(concat('1', repeat('0', length(d) - {half})) as bigint)", f"concat({kind}, cast(length(d) as string))", p)
    return let("d", digits, let("t", pair, f"concat(if({half} = 0, '', lpad(cast(t.l as string), {half}, '0')), lpad(cast(t.r as string), length(d) - {half}, '0'))"))


def luhn_sum(digits: str) -> str:
    """SQL: the sum that a check digit completes to a multiple of ten, of the digits before it."""
    n = f"(cast(substring({digits}, i, 1) as int) * (1 + (length({digits}) - i + 1) % 2))"
    return f"aggregate(sequence(1, length({digits})), 0, (s, i) -> s + if({n} > 9, {n} - 9, {n}))"


def number_sql(h: str, p: PiiParams) -> str:
    """Digits before the last are permuted and the check digit made anew. A match is cut to a valid number before."""
    body = permuted_digits("substring(n, 1, length(n) - 1)", "'number'", p)
    return let("n", digits_of(h), let("m", body, refilled(h, f"concat(m, cast(pmod(-{luhn_sum('m')}, 10) as string))")))


def phone_sql(h: str, p: PiiParams) -> str:
    """A country code stays. Of ten digits without one or behind a 1, area and exchange codes that can be (200 to 999)
    are permuted with the line among those that can be; where one can't be, both keep their first digits. Of other
    numbers all national digits are permuted; they must be 4 at least, and 15 digits in all at most."""
    area, exchange, line = "cast(substring(n, 1, 3) as bigint)", "cast(substring(n, 4, 3) as bigint)", "cast(substring(n, 7, 4) as bigint)"
    pair = feistel(f"({area} - 200) * 800 + {exchange} - 200", line, "640000", "10000", "'phone'", p)
    right = let("t", pair, "concat(lpad(cast(t.l div 800 + 200 as string), 3, '0'), lpad(cast(t.l % 800 + 200 as string), 3, '0'), lpad(cast(t.r as string), 4, '0'))")
    rest = permuted_digits("concat(substring(n, 2, 2), substring(n, 5))", "'phone'", p)
    other = let("o", rest, "concat(substring(n, 1, 1), substring(o, 1, 2), substring(n, 4, 1), substring(o, 3))")
    ten = f"if({area} >= 200 and {exchange} >= 200, {right}, {other})"
    national = permuted_digits("n", f"concat('phone', {'c'})", p)
    code = f"if(left({h}, 1) <> '+', '', if(w rlike '{CODES}', regexp_extract(w, '{CODES}', 0), substring(w, 1, 3)))"
    new = f"case when c in ('', '1') and length(n) = 10 then {ten} when c <> '' and length(n) >= 4 and length(w) <= 15 then {national} end"
    return let("w", digits_of(h), let("c", code, let("n", "substring(w, length(c) + 1)", refilled(h, f"concat(c, {new})"))))


def ssn_sql(h: str, p: PiiParams) -> str:
    """Area 001-899 but 666 (898 of them), group 01-99, serial 0001-9999; null if it isn't one of these."""
    area, group, serial = (f"cast(substring({h}, {at}, {n}) as int)" for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = f"{area} between 1 and 899 and {area} <> 666 and {group} > 0 and {serial} > 0"
    pair = feistel(f"({area} - if({area} > 666, 2, 1)) * 99 + {group} - 1", f"{serial} - 1", "898 * 99", "9999", "'ssn'", p)
    new = "cast(floor(t.l / 99) as int) + 1"
    out = f"concat(lpad(cast({new} + if({new} >= 666, 1, 0) as string), 3, '0'), '-', lpad(cast(t.l % 99 + 1 as string), 2, '0'), '-', lpad(cast(t.r + 1 as string), 4, '0'))"
    return f"if({valid}, {let('t', pair, out)}, null)"


def ip_sql(h: str, p: PiiParams) -> str:
    part = lambda i: f"cast(element_at(o, {i}) as bigint)"
    pair = feistel(f"{part(1)} * 256 + {part(2)}", f"{part(3)} * 256 + {part(4)}", "65536", "65536", "'ip'", p)
    out = "concat_ws('.', " + ", ".join(f"cast({x} as string)" for x in ("t.l div 256", "t.l % 256", "t.r div 256", "t.r % 256")) + ")"
    return let("o", f"split({h}, '[.]')", let("t", pair, out))


def date_sql(h: str, p: PiiParams) -> str:
    """Days of the years 1700 to 2099; null for others and for days that don't exist. 01/02/2003 is month, day, year;
    where that is no day, day, month, year."""
    y, m, d = "case when {0} rlike '^[0-9]{{4}}' then substring({0}, 1, 4) else substring({0}, 7, 4) end", "case when {0} rlike '^[0-9]{{4}}' then substring({0}, 6, 2) when {0} like '%.%' then substring({0}, 4, 2) else substring({0}, 1, 2) end", "case when {0} rlike '^[0-9]{{4}}' then substring({0}, 9, 2) when {0} like '%.%' then substring({0}, 1, 2) else substring({0}, 4, 2) end"
    day = "try_cast(concat_ws('-', " + ", ".join(x.format(h) for x in (y, m, d)) + ") as date)"
    turned = f"try_cast(concat_ws('-', substring({h}, 7, 4), substring({h}, 4, 2), substring({h}, 1, 2)) as date)"
    pair = feistel(f"n div {CYCLE_B}", f"n % {CYCLE_B}", str(CYCLE_A), str(CYCLE_B), "'date'", p)
    new = f"date_add(date '{FIRST_DAY}', cast(t.l * {CYCLE_B} + t.r as int))"
    style = f"case when {h} like '____-%' then 'yyyy-MM-dd' when {h} like '____/%' then 'yyyy/MM/dd' when {h} like '%.%' then 'dd.MM.yyyy' when {day} is null then 'dd/MM/yyyy' else 'MM/dd/yyyy' end"
    shown = f"case {style} when 'yyyy-MM-dd' then date_format({new}, 'yyyy-MM-dd') when 'yyyy/MM/dd' then date_format({new}, 'yyyy/MM/dd') when 'dd.MM.yyyy' then date_format({new}, 'dd.MM.yyyy') when 'dd/MM/yyyy' then date_format({new}, 'dd/MM/yyyy') else date_format({new}, 'MM/dd/yyyy') end"
    return let("n", f"datediff(coalesce({day}, if({h} like '__/%', {turned}, null)), date '{FIRST_DAY}')", f"if(n between 0 and {CYCLE_A * CYCLE_B - 1}, {let('t', pair, shown)}, null)")


def iban_mod(text: str) -> str:
    """SQL: remainder by 97 of an IBAN whose first four characters have been moved to the end."""
    value = "instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1"
    return f"aggregate(filter(split({text}, ''), c -> c <> ''), 0, (s, c) -> (s * if({value} > 9, 100, 10) + {value}) % 97)"


def iban_sql(h: str, p: PiiParams) -> str:
    """The digits of the account part are permuted and the check digits made anew; null if the check digits are wrong."""
    tail = "substring(w, 5)"
    valid = f"{iban_mod(f'concat({tail}, substring(w, 1, 4))')} = 1"
    body = refilled(tail, permuted_digits(digits_of(tail), "'iban'", p))
    check = f"lpad(cast(98 - {iban_mod('concat(v, substring(w, 1, 2), ' + chr(39) + '00' + chr(39) + ')')} as string), 2, '0')"
    new = let("v", body, f"concat(substring(w, 1, 2), {check}, v)")
    # Spaces stay where they were: the characters are dealt into the places that aren't spaces.
    step = "if(c = ' ', named_struct('o', concat(g.o, c), 'n', g.n, 'd', g.d), named_struct('o', concat(g.o, substring(g.d, g.n, 1)), 'n', g.n + 1, 'd', g.d))"
    spaced = f"aggregate(filter(split({h}, ''), c -> c <> ''), named_struct('o', '', 'n', 1, 'd', q), (g, c) -> {step}, g -> g.o)"
    return let("w", f"replace({h}, ' ', '')", f"if({valid} and length({digits_of(tail)}) between 1 and 30, {let('q', new, spaced)}, null)")


def email_sql(h: str, p: PiiParams) -> str:
    """The letters before the @ are permuted as a number to base 26, the digits as a decimal number, in runs of 12 whose
    tweak is the place of the run; case and other characters stay."""
    local = f"substring_index({h}, '@', 1)"
    letters, digits = f"regexp_replace(lower({local}), '[^a-z]', '')", digits_of(local)

    def base26(s: str) -> str:
        return f"aggregate(filter(split({s}, ''), c -> c <> ''), 0L, (s, c) -> s * 26 + ascii(c) - 97)"

    def word(n: str, size: str) -> str:
        return f"reverse(aggregate(sequence(1, greatest({size}, 1)), named_struct('n', cast({n} as bigint), 'o', ''), (s, i) -> if(i <= {size}, named_struct('n', s.n div 26, 'o', concat(s.o, char(cast(97 + s.n % 26 as int)))), s), s -> s.o))"

    run, half = "substring(x, k * 12 + 1, 12)", "cast(floor(length(r) / 2) as int)"
    power = lambda e: f"cast(round(power(26D, {e})) as bigint)"
    pair = feistel(base26(f"substring(r, 1, {half})"), base26(f"substring(r, {half} + 1)"), power(half), power(f"length(r) - {half}"), "concat('email', cast(k as string))", p)
    new_run = let("r", run, let("t", pair, f"concat({word('t.l', half)}, {word('t.r', f'length(r) - {half}')})"))
    all_runs = let("x", letters, f"if(x = '', '', array_join(transform(sequence(0, cast((length(x) - 1) div 12 as int)), k -> {new_run}), ''))")
    digit_run = permuted_digits("substring(x, k * 12 + 1, 12)", "concat('email', cast(k as string))", p)
    all_digits = let("x", digits, f"if(x = '', '', array_join(transform(sequence(0, cast((length(x) - 1) div 12 as int)), k -> {digit_run}), ''))")
    step = """case when c between '0' and '9' then named_struct('o', concat(g.o, substring(g.d, g.i, 1)), 'i', g.i + 1, 'd', g.d, 'j', g.j, 'e', g.e)
        when lower(c) between 'a' and 'z' then named_struct('o', concat(g.o, if(c between 'A' and 'Z', upper(substring(g.e, g.j, 1)), substring(g.e, g.j, 1))), 'i', g.i, 'd', g.d, 'j', g.j + 1, 'e', g.e)
        else named_struct('o', concat(g.o, c), 'i', g.i, 'd', g.d, 'j', g.j, 'e', g.e) end"""
    dealt = f"aggregate(filter(split({local}, ''), c -> c <> ''), named_struct('o', '', 'i', 1, 'd', {all_digits}, 'j', 1, 'e', {all_runs}), (g, c) -> {step}, g -> g.o)"
    return f"concat({dealt}, substring({h}, length({local}) + 1))"


def iban_extent(h: str) -> str:
    """SQL: how many characters of a match are the IBAN: its country's length if the check digits are right there, or
    else the whole match; for a country not listed the longest of the right ones. Null if there is none."""
    part = f"substring({h}, 1, i)"
    right = f"{let('v', f'replace({part}, {chr(39)} {chr(39)}, {chr(39)}{chr(39)})', iban_mod('concat(substring(v, 5), substring(v, 1, 4))'))} = 1"
    at = f"instr('{IBAN_LENGTHS}', substring({h}, 1, 2))"
    known = f"if({at} > 0, cast(substring('{IBAN_LENGTHS}', {at} + 2, 2) as int), 0)"
    ends = f"filter(sequence(15, length({h})), i -> (i = length({h}) or substring({h}, i + 1, 1) = ' ') and {right})"
    own = f"array_max(filter(e, i -> length(replace({part}, ' ', '')) = n))"
    return let("n", known, let("e", ends, f"coalesce({own}, array_max(filter(e, i -> n = 0 or i = length({h}))))"))


def number_extent(h: str) -> str:
    """SQL: how many characters of a match are the number: up to an end where the check digit is right, at the usual
    length of such a card if it is right there, or else the longest; null if none is."""
    part = f"substring({h}, 1, i)"
    right = let("v", digits_of(part), f"length(v) between 13 and 19 and pmod(cast(substring(v, -1, 1) as int) + {luhn_sum('substring(v, 1, length(v) - 1)').replace('(s, i)', '(t, j)').replace(', i, 1', ', j, 1').replace('- i + 1', '- j + 1').replace('s + if', 't + if')}, 10) = 0")
    ends = f"filter(sequence(13, length({h})), i -> (i = length({h}) or substring({h}, i + 1, 1) in (' ', '-')) and {right})"
    usual = f"case when {h} rlike '^3[ -]?[47]' then 15 when {h} rlike '^(?:4|5[ -]?[1-5]|2[ -]?[2-7]|6[ -]?[045])' then 16 else 0 end"
    own = f"array_max(filter(e, i -> length({digits_of(f'substring({h}, 1, i)')}) = {usual}))"
    return let("e", ends, f"coalesce({own}, array_max(e))")


EXTENTS = {"iban": iban_extent, "number": number_extent}
MAKERS = {"email": email_sql, "iban": iban_sql, "date": date_sql, "ip": ip_sql, "ssn": ssn_sql, "phone": phone_sql, "number": number_sql}


def pseudonymised(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """docs with text rewritten, and pii_found, an array of structs (kind, pseudonym), in text order.

    Null texts stay null and have nothing found; empty texts stay empty. A match that isn't valid of its kind stays as
    it is and isn't counted; the search goes on at the next place where one starts, inside it too, and after a valid one
    where that ends. Rows are rewritten one by one; repeated rows, null keys and other columns stay.
    """
    either = "|".join(PATTERNS.values())
    pattern, starts, ahead = sql_text(either), sql_text(f"(?={either})"), sql_text(f"(?=({either}))")
    whole = {k: sql_text(f"^(?:{v})$") for k, v in PATTERNS.items()}
    kind = "case " + " ".join(f"when h rlike {whole[k]} then '{k}'" for k in PATTERNS) + " end"
    extent = "case z.k " + " ".join(f"when '{k}' then {EXTENTS[k]('z.h')}" for k in EXTENTS) + " else length(z.h) end"
    maker = "case z.k " + " ".join(f"when '{k}' then {MAKERS[k]('z.h', params)}" for k in PATTERNS) + " end"
    # Texts without a match are searched once and stay as they are. Others are cut at each place where a match starts.
    key = docs.sparkSession.createDataFrame([(params.key,)], "key string")
    rows = boxed(docs, _text=F.col("text")).withColumn("_key", key.scalar()).withColumn("_has", F.expr(f"coalesce(_text rlike {pattern}, false)"))
    hits = rows.withColumn("_hits", F.expr(f"if(_has, transform(regexp_extract_all(_text, {ahead}, 1), h -> named_struct('h', h, 'k', {kind})), cast(array() as array<struct<h:string,k:string>>))"))
    hits = hits.withColumn("_hits", F.expr(f"transform(_hits, z -> named_struct('k', z.k, 'h', substring(z.h, 1, {extent})))"))
    made = hits.withColumn("_new", F.expr(f"transform(_hits, z -> named_struct('k', z.k, 'n', length(z.h), 'p', {maker}))"))
    made = made.withColumn("_cut", F.expr(f"if(_has, split(_text, {starts}, -1), array(_text))"))
    made = made.withColumn("_gap", F.expr("size(_cut) - size(_new)"))  # 1 if no match starts the text
    # a.left: characters of the next pieces that the last valid match has taken.
    taken = "named_struct('left', greatest(a.left - length(x.b), 0), 'out', concat(a.out, array(substring(x.b, a.left + 1))), 'found', a.found)"
    stays = "named_struct('left', 0, 'out', concat(a.out, array(x.b)), 'found', a.found)"
    valid = "named_struct('left', greatest(x.m.n - length(x.b), 0), 'out', concat(a.out, array(concat(x.m.p, substring(x.b, x.m.n + 1)))), 'found', concat(a.found, array(named_struct('kind', x.m.k, 'pseudonym', x.m.p))))"
    start = "named_struct('left', 0, 'out', slice(_cut, 1, _gap), 'found', cast(array() as array<struct<kind:string,pseudonym:string>>))"
    made = made.withColumn("_done", F.expr(f"aggregate(zip_with(slice(_cut, _gap + 1, size(_new)), _new, (b, m) -> named_struct('b', b, 'm', m)), {start}, (a, x) -> case when a.left > 0 then {taken} when x.m.p is null then {stays} else {valid} end)"))
    joined = "if(_has, array_join(_done.out, ''), _text)"
    found = F.col("_done.found")
    columns = [F.expr(joined).alias("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns if c != "pii_found"]
    return made.select(*columns, found.alias("pii_found"))


def pii(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """doc_id, the rewritten text and the number of pseudonyms of each kind for every row of docs (doc_id, text)."""
    out = pseudonymised(docs.select("doc_id", "text"), params)
    counts = [F.expr(f"cast(size(filter(pii_found, m -> m.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in PATTERNS]
    return out.select("doc_id", "text", *counts)

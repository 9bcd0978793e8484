"""Structure of Java tokens: depths, partners and members, a whole run of files at a time.

``structure`` takes the token rows of files and adds what a window per file and
depth would: running sums within a file are one ``cumsum`` over all tokens of the
run less its value at the file's start, and neighbours at one depth are
neighbours after one stable sort by (file, depth).  No file is cut; a task holds
a run of ``RUN`` tokens, or one file if that is longer.

``grouped`` goes on from there to the members of bodies and to the calls of
method bodies.  Both lie within a file, so they are put together where the file's
tokens are and no row per token is ever sent or written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN = 200_000  # tokens taken together
SCHEMA = ("fa long, fb long, i int, t string, len int, pos int, line int, prev string, next string, gap boolean, d int, "
          "is_paren boolean, bd int, p int, g int, angled boolean, own int, inner_p int, mate int, behind string, s1 int, "
          "after_eq boolean, m int, typed boolean, in_type boolean, block int")
# a row is a member of a file (``own`` not null) or a method body with calls (``block`` not null)
GROUPS = ("fa long, fb long, repo_id string, path string, package string, imports array<string>, own int, m int, typed boolean, "
          "in_type boolean, s1 int, toks array<struct<i:int,pos:int,len:int,t:string,gap:boolean,inner_p:int,g:int,mate:int>>, "
          "block int, words array<struct<k:int,t:string,gap:boolean,p:int,bd:int,g:int>>, calls array<struct<k:int,name:string,"
          "pos:int,line:int,p:int,bd:int,g:int,args_closed:struct<k:int,pos:int>,scoped:boolean,start:struct<k:int,pos:int,line:int>>>")
# Keywords that look like call names; those that may stand before a call.
NOT_CALLS = ["if", "for", "while", "switch", "catch", "synchronized", "return", "throw", "new",
             "super", "this", "assert", "try", "do", "else", "case"]
BEFORE_CALLS = ["return", "throw", "else", "do", "case", "yield", "assert", "instanceof"]


def runs_of_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole files (equal ``fa``, ``fb``, rows together) in tables of about ``RUN`` rows."""
    held, rows, last = [], 0, None
    for b in batches:
        if not b.num_rows:
            continue
        fa, fb = b["fa"].to_numpy(), b["fb"].to_numpy()
        new = np.flatnonzero((fa[1:] != fa[:-1]) | (fb[1:] != fb[:-1])) + 1
        cut = int(new[-1]) if len(new) else (0 if last is not None and last != (fa[0], fb[0]) else None)
        if cut is not None and rows + cut >= RUN:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held, rows, b = [], 0, b.slice(cut)
        held.append(b)
        rows, last = rows + b.num_rows, (fa[-1], fb[-1])
    if held:
        yield pa.Table.from_batches(held)


class Groups:
    """Rows grouped by keys, in row order within a group."""

    def __init__(self, *keys: np.ndarray):
        self.order = np.lexsort(keys[::-1])
        new = np.zeros(len(self.order), bool)
        new[:1] = True
        for k in keys:
            s = k[self.order]
            new[1:] |= s[1:] != s[:-1]
        self.new = new

    def _starts(self, new: np.ndarray) -> np.ndarray:
        return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))

    def back(self, x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        out[self.order] = x
        return out

    def following(self) -> np.ndarray:
        """Row number of the next row of the group, -1 for the last."""
        nxt = np.full(len(self.order), -1, np.int64)
        nxt[:-1] = np.where(self.new[1:], -1, self.order[1:])
        return self.back(nxt)

    def before(self) -> np.ndarray:
        prv = np.full(len(self.order), -1, np.int64)
        prv[1:] = np.where(self.new[1:], -1, self.order[:-1])
        return self.back(prv)

    def last(self, flag: np.ndarray) -> np.ndarray:
        """Row number of the last flagged row up to this one, -1 if none."""
        at = np.maximum.accumulate(np.where(flag[self.order], np.arange(len(flag)), -1))
        return self.back(np.where(at >= self._starts(self.new), self.order[at], -1))

    def sum(self, x: np.ndarray) -> np.ndarray:
        """Running sum, this row included."""
        s = np.cumsum(x[self.order].astype(np.int64))
        first = self._starts(self.new)
        return self.back(s - (s - x[self.order])[first])

    def any(self, flag: np.ndarray) -> np.ndarray:
        """Whether any row of the group is flagged."""
        n = np.cumsum(self.new) - 1
        return self.back(np.bincount(n, flag[self.order])[n] > 0)


def _pick(x: np.ndarray, at: np.ndarray, missing):
    return np.where(at >= 0, x[at], missing)


def _word(s: str) -> bool:
    return bool(s) and (s[0] in "_$" or s[0] >= "\x80" or s[0].isalpha())


def structure(tokens: pa.Table) -> pa.Table:
    """Token rows ``(fa, fb, i, n, nl, t)`` of whole files (see ``facts.java_tokens``)."""
    fa, fb, i, n, nl = (tokens[c].to_numpy() for c in ("fa", "fb", "i", "n", "nl"))
    new = np.ones(len(fa), bool)
    new[1:] = (fa[1:] != fa[:-1]) | (fb[1:] != fb[:-1])
    f = np.cumsum(new)
    text = tokens["t"].combine_chunks().cast(pa.string())
    by_i = np.lexsort((i, f))  # a file that comes twice: its tokens side by side
    fa, fb, i, n, nl, text = fa[by_i], fb[by_i], i[by_i], n[by_i], nl[by_i], text.take(pa.array(by_i))
    words = text.dictionary_encode()
    code, words = words.indices.to_numpy(), words.dictionary.to_pylist()
    of_word = lambda fn, kind=bool: np.array([fn(w) for w in words], kind)[code]
    length, within = of_word(len, np.int64), of_word(lambda w: w.count("\n"), np.int64)
    file = Groups(f)
    pos = file.sum(n + length) - length + 1
    line = file.sum(nl + within) - within + 1
    keep = ~of_word(lambda w: w.startswith(("//", "/*")))
    fa, fb, f, i, code, length, pos, line = (x[keep] for x in (fa, fb, f, i, code, length, pos, line))
    text = text.filter(pa.array(keep))
    one_of = lambda *ws: of_word(lambda w: w in ws)
    file, size = Groups(f), len(f)
    prv, nxt = file.before(), file.following()
    after = lambda x: _pick(x, nxt, False)   # of the next token, false at the end
    behind = lambda x: _pick(x, prv, False)  # of the token before
    gap = pos > _pick(pos + length, prv, np.iinfo(np.int64).max)
    left, right = one_of("{"), one_of("}")
    # braces around a list of values nest like parentheses
    d = file.sum(left * 1 - right) - left
    lists = left & behind(one_of("(", ",", "=", "]", "default"))
    lists = np.where(right, _pick(lists, Groups(f, d, left | right).before(), False), lists)
    opens, closes = left & ~lists, right & ~lists
    deeper = one_of("(", "[") | (left & lists)
    is_paren = one_of("(", ")", "[", "]") | ((left | right) & lists)
    bd = file.sum(opens * 1 - closes)
    p_after = file.sum(np.where(deeper, 1, -1 * is_paren))
    p, d = p_after - deeper, bd - opens
    # angle brackets: runs of type tokens, levels in a run, partners at a level
    word, less, more = of_word(_word), one_of("<"), one_of(">")
    typish = word | one_of(".", ",", "&", "<", ">", "[", "]", "@") | (
        one_of("?") & (after(one_of(">", ",", "extends", "super")) | (nxt < 0)))
    run = file.sum(~typish)
    level = Groups(f, run).sum(less * 1 - more) + more
    some = np.flatnonzero(less | more)
    pairs = Groups(f[some], run[some], level[some])
    angle = np.zeros(size, np.int64)
    angle[some] = less[some] & _pick(more[some], pairs.following(), False)
    angle[some] -= more[some] & _pick(less[some], pairs.before(), False)
    g = file.sum(angle) - (angle == 1)
    # the body around a token, and partners of braces and parentheses
    opener = Groups(f, bd).last(opens)
    own = _pick(pos, opener, 0)
    inner_p = p - _pick(p_after, opener, 0)
    pair = Groups(f, d, opens | closes)
    partner, partner_p = pair.following(), Groups(f, p, is_paren).following()
    mate = np.where(opens & (partner >= 0), pos[partner], -1)
    own = np.where(opens, _pick(own, partner, 0), own)
    inner_p = np.where(opens, _pick(inner_p, partner, 0), inner_p)
    behind_p = np.where(deeper & (partner_p >= 0), nxt[partner_p], -1)
    # members of a body
    outer, semicolon = inner_p == 0, one_of(";")
    body = Groups(f, own)
    stop = semicolon & outer
    s1 = body.sum(stop) - stop
    gives = one_of("=") | (one_of("default") & behind(one_of(")")))  # what follows ends at a semicolon
    after_eq = Groups(f, own, s1).sum(gives & outer & (g == 0)) > 0
    ends = outer & (semicolon | (closes & ~after_eq))
    m = body.sum(ends) - ends
    declares = one_of("class", "interface", "enum") & ~behind(one_of(".")) & after(word) & outer & (g == 0) & ~after_eq
    typed = Groups(f, own, m).any(declares)
    block_brace = opens & outer & ~after_eq
    in_type = _pick(block_brace & typed, opener, False)
    in_type = np.where(opens, _pick(in_type, partner, False), in_type)
    starts = block_brace & in_type & ~typed
    stops = closes & _pick(starts, pair.before(), False)
    fd = file.sum(np.where(starts, 1, -1 * stops))
    block = _pick(pos, Groups(f, fd).last(starts), -1)
    ints = lambda x, none=None: pa.array(x, pa.int32(), mask=None if none is None else x == none)
    token_at = lambda at: text.take(pa.array(at, pa.int64(), mask=at < 0))
    out = {"fa": pa.array(fa), "fb": pa.array(fb), "i": ints(i), "t": text, "len": ints(length), "pos": ints(pos),
           "line": ints(line), "prev": token_at(prv), "next": token_at(nxt), "gap": pa.array(gap), "d": ints(d),
           "is_paren": pa.array(is_paren), "bd": ints(bd), "p": ints(p), "g": ints(g), "angled": pa.array(angle != 0),
           "own": ints(own), "inner_p": ints(inner_p), "mate": ints(mate, -1), "behind": token_at(behind_p), "s1": ints(s1),
           "after_eq": pa.array(after_eq), "m": ints(m), "typed": pa.array(typed), "in_type": pa.array(in_type),
           "block": ints(block, -1)}
    return pa.table(out)


def structured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in runs_of_files(batches):
        yield from structure(run).to_batches(max_chunksize=16_384)


def _struct(**fields: pa.Array) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(fields.values()), list(fields))


def _lists(starts: np.ndarray, size: int, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, size), pa.int32()), values)


class _Texts:
    """Tests on a column of texts, each distinct text looked at once."""

    def __init__(self, column: pa.Array):
        coded = column.fill_null("").dictionary_encode()
        self.code, self.words = coded.indices.to_numpy(), coded.dictionary.to_pylist()

    def of(self, fn) -> np.ndarray:
        return np.array([bool(fn(w)) for w in self.words], bool)[self.code]

    def one_of(self, *ws: str) -> np.ndarray:
        return self.of(lambda w: w in ws)

    def word(self) -> np.ndarray:
        return self.of(_word)


def members(tokens: pa.Table, f: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Members of type bodies and declarations of types with their tokens: the
    file of each, and its columns."""
    num = lambda c: tokens[c].to_numpy()
    at = np.flatnonzero(num("typed") | num("in_type"))
    keys = [f[at], *(num(c)[at] for c in ("own", "m", "typed", "in_type"))]
    groups = Groups(*keys)
    at, starts = at[groups.order], np.flatnonzero(groups.new)
    part = tokens.take(pa.array(at))
    col = lambda c: part[c].combine_chunks()
    first = lambda c: col(c).take(pa.array(starts))
    if not len(at):
        return at, {}
    s1 = np.minimum.reduceat(num("s1")[at], starts)
    toks = _struct(**{c: col(c) for c in ("i", "pos", "len", "t", "gap", "inner_p", "g", "mate")})
    return f[at][starts], {**{c: first(c) for c in ("own", "m", "typed", "in_type")}, "s1": pa.array(s1, pa.int32()),
                           "toks": _lists(starts, len(at), toks)}


def calls(tokens: pa.Table, f: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Method bodies that hold calls, with their tokens and, for each call, what
    ``facts.extract_calls`` cuts its texts from."""
    inside = np.flatnonzero(tokens["block"].is_valid().to_numpy())
    if not len(inside):
        return inside, {}
    x, f = tokens.take(pa.array(inside)), f[inside]
    num = lambda c: x[c].to_numpy()
    block, p, d, g, pos, line = (num(c) for c in ("block", "p", "d", "g", "pos", "line"))
    t, prev, nxt, behind = (_Texts(x[c].combine_chunks()) for c in ("t", "prev", "next", "behind"))
    body = Groups(f, block)
    k = body.sum(np.ones(len(f), np.int64))
    opens = t.one_of("(")
    goes_on = (t.one_of(".", ")", "]", "}") | (t.one_of("{") & prev.one_of(")", "]")) | prev.one_of(".") | num("angled") | (g > 0)
               | (prev.one_of("new") & t.word()) | (opens & (prev.word() | prev.one_of(">")) & ~prev.one_of(*NOT_CALLS))
               | (t.one_of("[") & (prev.word() | prev.one_of(")", "]"))))
    start = Groups(f, block, p, d).last(~goes_on)
    closed = np.where(opens, Groups(f, block, p, num("is_paren")).following(), -1)
    after = body.following()
    args_closed = np.where(after >= 0, closed[after], -1)
    args_behind = (after >= 0) & behind.one_of("{", "throws")[after]
    is_call = (t.word() & nxt.one_of("(") & ~t.one_of(*NOT_CALLS) & ~prev.one_of("new", "@", "]") & (args_closed >= 0)
               & ~(prev.word() & ~prev.one_of(*BEFORE_CALLS)) & ~args_behind)
    ints = lambda a: pa.array(a, pa.int32())
    order = body.order
    number = np.cumsum(body.new) - 1  # of the body, by place in ``order``
    holds = (np.bincount(number, is_call[order]) > 0)[number]
    mine, which = order[holds], number[holds]
    keep = x.take(pa.array(mine))
    starts = np.flatnonzero(np.diff(which, prepend=-1))
    words = _struct(k=ints(k[mine]), **{c: keep[c].combine_chunks() for c in ("t", "gap", "p", "bd", "g")})
    at = mine[is_call[mine]]
    first = np.cumsum(is_call[mine]) - is_call[mine]  # calls before a token
    some = x.take(pa.array(at))
    col = lambda c: some[c].combine_chunks()
    c, s = args_closed[at], start[at]
    begun = pa.StructArray.from_arrays([ints(k[s]), ints(pos[s]), ints(line[s])], ["k", "pos", "line"], mask=pa.array(s < 0))
    call = _struct(k=ints(k[at]), name=col("t"), pos=col("pos"), line=col("line"), p=col("p"), bd=col("bd"), g=col("g"),
                   args_closed=_struct(k=ints(k[c]), pos=ints(pos[c])), scoped=pa.array(prev.one_of(".")[at]), start=begun)
    return f[mine][starts], {"block": keep["block"].combine_chunks().take(pa.array(starts)), "words": _lists(starts, len(mine), words),
                             "calls": _lists(first[starts], len(at), call)}


def whole_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of files, those of one file (equal ``fa``, ``fb``) in one table."""
    held = []
    for b in batches:
        if not b.num_rows:
            continue
        fa, fb = b["fa"].to_numpy(), b["fb"].to_numpy()
        new = np.flatnonzero((fa[1:] != fa[:-1]) | (fb[1:] != fb[:-1])) + 1
        if held and (held[-1]["fa"][-1].as_py(), held[-1]["fb"][-1].as_py()) != (fa[0], fb[0]):
            yield pa.Table.from_batches(held)
            held = []
        if len(new):
            yield pa.Table.from_batches([*held, b.slice(0, int(new[-1]))])
            held, b = [], b.slice(int(new[-1]))
        held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _grouped(files: pa.Table) -> Iterator[pa.Table]:
    z = files["z"].combine_chunks()
    size = pc.list_value_length(z).fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), size)
    i = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    n, nl, t = pc.list_flatten(z).flatten()
    fa, fb = files["fa"].to_numpy(), files["fb"].to_numpy()
    new = np.ones(len(fa), bool)
    new[1:] = (fa[1:] != fa[:-1]) | (fb[1:] != fb[:-1])
    number, starts = np.cumsum(new) - 1, np.flatnonzero(new)
    has = t.is_valid()
    tokens = structure(pa.table({"fa": fa[row], "fb": fb[row], "i": pa.array(i, pa.int32()), "n": n, "nl": nl, "t": t}).filter(has))
    if not tokens.num_rows:
        return
    # the file of a token; files without one are left out there
    of_key = {key: at for at, key in enumerate(zip(fa[starts].tolist(), fb[starts].tolist(), strict=True))}
    ta, tb = tokens["fa"].to_numpy(), tokens["fb"].to_numpy()
    change = np.ones(len(ta), bool)
    change[1:] = (ta[1:] != ta[:-1]) | (tb[1:] != tb[:-1])
    f = np.array([of_key[key] for key in zip(ta[change].tolist(), tb[change].tolist(), strict=True)])[np.cumsum(change) - 1]
    rows = np.bincount(number)  # a file that comes twice has its members twice
    for part, each in ((members, True), (calls, False)):
        of, columns = part(tokens, f)
        if not len(of):
            continue
        again = rows[of] if each else np.ones(len(of), np.int64)
        at = np.repeat(np.arange(len(of)), again)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(again) - again, again)
        file = files.select(["fa", "fb", "repo_id", "path", "package", "imports"] if each else ["fa", "fb"]).take(
            pa.array(starts[of][at] + nth))
        some = {c: file[c] for c in file.column_names}
        some |= columns if len(at) == len(of) else {c: x.take(pa.array(at)) for c, x in columns.items()}
        yield pa.table(some)


def grouped(schema: pa.Schema):
    """For ``mapInArrow``: rows of files ``(fa, fb, repo_id, path, package, imports,
    z)``, ``z`` their tokens as ``array<struct<n, nl, t>>``, become rows of ``GROUPS``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in whole_files(batches):
            for made in _grouped(files):
                full = [made[f.name].cast(f.type) if f.name in made.column_names else pa.nulls(made.num_rows, f.type) for f in schema]
                yield from pa.table(full, schema=schema).to_batches(max_chunksize=1_024)
    return run

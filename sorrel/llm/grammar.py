"""Permissible token pairs, derived from grammars.

A grammar is text: ``name: alternative | alternative``; an alternative is a row of symbols, each with an optional ``?`` or ``*``.
Symbols that name a rule are nonterminals. Two classes may stand side by side when some production puts the last class of one
symbol before the first class of the next.
"""

from __future__ import annotations

import keyword
from functools import lru_cache

from sorrel.llm import js_grammar as js

PYTHON = """
file: stmt*
stmt: line | compound
line: small more* semi? NEWLINE
more: ; small
semi: ;
small: exprs assign* | exprs aug value | exprs : test given? | pass | break | continue | return exprs? | raise test cause? | raise | global names | nonlocal names | del exprs | assert test message? | import modules | from dots* dotted import imported | from dots dots* import imported | type NAME tparams? = test | yield_
assign: = value
given: = value
aug: += | -= | *= | /= | //= | %= | @= | &= | PIPE= | ^= | >>= | <<= | **=
value: exprs | yield_
yield_: yield | yield exprs | yield from test
cause: from test
message: , test
names: NAME | NAME , names
modules: module | module , modules
module: dotted alias?
dotted: NAME | NAME . dotted
alias: as NAME
dots: . | ...
imported: * | aliases | ( aliases comma? )
aliases: NAME alias? | NAME alias? , aliases
comma: ,
compound: if test : block elifs* else_? | while test : block else_? | for exprs in exprs : block else_? | async for exprs in exprs : block else_? | try : block excepts* else_? finally_? | with withs : block | async with withs : block | with ( withs comma? ) : block | function_ | class_ | decorator decorator* function_ | decorator decorator* class_ | match exprs : NEWLINE INDENT cases cases* DEDENT
decorator: @ test NEWLINE
elifs: elif test : block
else_: else : block
finally_: finally : block
excepts: except : block | except exprs name_? : block | except * exprs name_? : block
name_: as NAME
withs: with_ | with_ , withs
with_: test | test as target
target: exprs
block: line | NEWLINE INDENT stmt stmt* DEDENT
function_: def NAME tparams? ( params? ) arrow? : block | async def NAME tparams? ( params? ) arrow? : block
arrow: -> exprs
tparams: [ tparam_list comma? ]
tparam_list: tparam | tparam , tparam_list
tparam: NAME bound? default? | * NAME default? | ** NAME default?
bound: : test
params: param | param , | param , params
param: NAME note? default? | * | * NAME note? | ** NAME note? | /
note: : test | : * test
default: = test
class_: class NAME tparams? callargs? : block
callargs: ( args? )
cases: case patterns guard? : block
guard: if test
patterns: exprs | exprs as NAME
exprs: starred | starred , | starred , exprs
starred: test | * test | test := test
test: or_ | or_ if or_ else test | lambda lparams? : test
lparams: lparam | lparam , | lparam , lparams
lparam: NAME default? | * | * NAME | ** NAME | /
or_: not* operand | not* operand binop or_
binop: or | and | < | > | == | != | <= | >= | in | not in | is | is not | PIPE | ^ | & | << | >> | + | - | * | / | // | % | @ | **
operand: sign* await_? atom trailer*
await_: await
sign: + | - | ~
atom: NAME | NUM | strings | None | True | False | ... | ( exprs? ) | ( exprs comp ) | ( yield_ ) | [ exprs? ] | [ exprs comp ] | { items? } | { item comp }
strings: STR | FSTR | BSTR | STR strings | FSTR strings | BSTR strings
items: item | item , | item , items
item: starred | test : test | ** test | test as NAME
comp: for exprs in or_ comps* | async for exprs in or_ comps*
comps: for exprs in or_ | async for exprs in or_ | if test
trailer: ( args? ) | [ subs ] | . NAME
args: arg | arg , | arg , args
arg: starred | NAME = test | ** test | test comp
subs: sub | sub , | sub , subs
sub: starred | test? : test? | test? : test? : test?
"""

JAVASCRIPT = """
file: item*
item: stmt | import from_? STR end | import defaults from STR end | export * ename? from STR end | export { specs? } fromx? end | export decl | export default decl | export default expr end
from_: from
fromx: from STR
ename: as mname
defaults: ident | ident , names_ | names_
names_: * as ident | { specs? }
specs: spec | spec , | spec , specs
spec: mname | mname as mname
mname: ident | STR | word
decl: var_ end | function_ | class_
stmt: block | ; | decl | expr end | if ( expr ) stmt else_? | for await_? ( head ) stmt | while ( expr ) stmt | do stmt while ( expr ) semi? | continue ident? end | break ident? end | return expr? end | throw expr end | with ( expr ) stmt | switch ( expr ) { cases* } | try block catch_? finally_? | debugger end | ident : stmt
semi: ;
await_: await
end: ;
else_: else stmt
head: start? ; expr? ; expr? | start in expr | start of asg
start: expr | let binds | const binds | var binds
cases: case expr : stmt* | default : stmt*
catch_: catch block | catch ( target ) block
finally_: finally block
var_: let binds | const binds | var binds
binds: bind | bind , binds
bind: target | target = asg
target: ident | [ targets? ] | { props_? }
targets: , | tgt | tgt , | tgt , targets | , targets | ... target
tgt: target | target = asg
props_: prop_ | prop_ , | prop_ , props_
prop_: ident init? | name : tgt | ... ident
init: = asg
block: { stmt* }
function_: async_? function star? ident? ( params? ) block
async_: async
star: *
params: param | param , | param , params
param: target init? | ... target
class_: class ident? heritage? { member* }
heritage: extends lhs
member: ; | static_? async_? star? key ( params? ) block | static_? accessor key ( params? ) block | static_? key init? end | static block
static_: static
accessor: get | set
key: name | PRIV
name: ident | word | STR | NUM | [ asg ]
expr: asg | asg , expr
asg: cond | lhs op asg | arrow | yield star? asg | yield
op: = | += | -= | *= | /= | %= | **= | <<= | >>= | >>>= | &= | PIPE= | ^= | &&= | PIPEPIPE= | ??=
arrow: async_? ident => body | async_? ( params? ) => body
body: asg | block
cond: bin | bin ? asg : asg
bin: un | un bop bin | PRIV in bin
bop: ?? | PIPEPIPE | && | PIPE | ^ | & | == | != | === | !== | < | > | <= | >= | instanceof | in | << | >> | >>> | + | - | * | / | % | **
un: pre* lhs post?
pre: delete | void | typeof | + | - | ~ | ! | ++ | -- | await
post: ++ | --
lhs: prim tail* | new lhs | new . target | super tail tail* | import ( asg ) tail* | import . meta tail*
tail: . prop | ?. prop | ?. ( args? ) | ?. [ expr ] | [ expr ] | ( args? ) | tpl
prop: ident | word | PRIV
args: arg | arg , | arg , args
arg: asg | ... asg
prim: ident | NUM | STR | REGEX | this | null | true | false | tpl | ( expr ) | [ elems? ] | { props? } | function_ | class_
tpl: TPL | TPLH expr mids* TPLT
mids: TPLM expr
elems: , | arg | arg , | arg , elems | , elems
props: pr | pr , | pr , props
pr: ident init? | name : asg | ... asg | async_? star? name ( params? ) block | accessor name ( params? ) block
"""

JSON = """
file: value
value: STR | NUM | WORD | { } | { members } | [ ] | [ elements ]
members: KEY : value | KEY : value ,o members
elements: value | value ,a elements
"""

TOML = """
file: line*
line: NEWLINE | keyval NEWLINE | T[ key T] NEWLINE | TT[ key TT] NEWLINE
keyval: key = value
key: KEY | KEY . key
value: STR | MLSTR | INT | FLOAT | BOOL | DATE | [ ] | [ items ,a? ] | { } | { pairs }
items: value | value ,a items
pairs: keyval | keyval ,i pairs
"""


def _symbol(s: str) -> tuple[str, str]:
    """A symbol and its repetition mark; signs of the language that look like marks stay whole."""
    base = s.rstrip("?*")
    return (base, s[len(base) :]) if base and (base[0].isalpha() or base == ",a") else (s, "")


def pairs_of(text: str, start: str = "file") -> tuple[set[tuple[str, str]], dict[str, set[str]], dict[str, set[str]]]:
    """Permissible pairs (with BOF and EOF), and the FIRST and LAST sets of each rule."""
    rules: dict[str, list[list[tuple[str, str]]]] = {}
    for row in text.strip().split("\n"):
        name, _, body = row.partition(": ")
        rules[name] = [[_symbol(s) for s in alt.split()] for alt in body.split(" | ")]
    real = lambda s: s.replace("PIPE", "|")
    empty: set[str] = set()
    first: dict[str, set[str]] = {n: set() for n in rules}
    last: dict[str, set[str]] = {n: set() for n in rules}
    skips = lambda s, m: bool(m) or s in empty
    get = lambda table, s: table[s] if s in rules else {real(s)}
    changed = True
    while changed:
        before = (len(empty), sum(map(len, first.values())), sum(map(len, last.values())))
        for n, alts in rules.items():
            for alt in alts:
                if all(skips(s, m) for s, m in alt):
                    empty.add(n)
                for table, order in ((first, alt), (last, alt[::-1])):
                    for s, m in order:
                        table[n] |= get(table, s)
                        if not skips(s, m):
                            break
        changed = before != (len(empty), sum(map(len, first.values())), sum(map(len, last.values())))
    out: set[tuple[str, str]] = set()
    for alts in rules.values():
        for alt in alts:
            for k, (s, m) in enumerate(alt):
                if m == "*":
                    out |= {(a, b) for a in get(last, s) for b in get(first, s)}
                for t, u in alt[k + 1 :]:
                    out |= {(a, b) for a in get(last, s) for b in get(first, t)}
                    if not skips(t, u):
                        break
    out |= {("BOF", b) for b in first[start]} | {(a, "EOF") for a in last[start]}
    if start in empty:
        out.add(("BOF", "EOF"))
    return out, first, last


@lru_cache(8)
def heads(text: str) -> frozenset[str]:
    return frozenset(row.partition(": ")[0] for row in text.strip().split("\n"))


SOFT = ("match", "case", "type", "_")
LANGUAGES = ("python", "javascript", "json", "toml")
NLS = 1024


@lru_cache(1)
def classes() -> tuple[str, ...]:
    """All token classes; a class's place is its code. Newline-marked classes have NLS more."""
    names = {"BOF", "EOF", "ERR", "NAME"} | set(SOFT) | set(keyword.kwlist) | js.RESERVED | js.CONTEXTUAL | set(js.UNARY) | set(js.BINARY) | set(js.ASSIGN)
    names |= {"(", ")", "[", "]", "{", "}", ";", ",", ".", "...", "?.", "=>", "?", ":", "++", "--", "!", "@", "REGEX", "PRIV", "TPL", "TPLH", "TPLM", "TPLT", "->", ":=", "//", "//=", "@=", "<>", "$", "`"}
    for text in (PYTHON, JAVASCRIPT, JSON, TOML):
        known = heads(text)
        for row in text.strip().split("\n"):
            for s in row.partition(": ")[2].replace(" | ", " ").split():
                if _symbol(s)[0] not in known:
                    names.add(_symbol(s)[0].replace("PIPE", "|"))
    return tuple(sorted(names | {"NLI", ",0"}))


@lru_cache(1)
def codes() -> dict[str, int]:
    base = {n: k for k, n in enumerate(classes())}
    return base | {js.NL + n: k + NLS for n, k in base.items()}


@lru_cache(1)
def permitted() -> list[tuple[str, int]]:
    """(language, first code * 2048 + second code) of every permissible pair."""
    out: list[tuple[str, int]] = []
    code = codes()
    add = lambda lang, a, b: out.append((lang, code[a] * 2048 + code[b]))
    found, _, _ = pairs_of(PYTHON)
    soft = lambda x: (x, *SOFT) if x == "NAME" else (x,)
    for a, b in found:
        for x in soft(a):
            for y in soft(b):
                add("python", x, y)
    for lang, text in (("json", JSON), ("toml", TOML)):
        for a, b in pairs_of(text)[0]:
            add(lang, a, b)
    # identifiers of JavaScript: NAME and the contextual words; ``word``: any reserved word
    text = JAVASCRIPT + "ident: " + " | ".join(["NAME", *sorted(js.CONTEXTUAL)]) + "\nword: " + " | ".join(sorted(js.RESERVED)) + "\n"
    found, first, last = pairs_of(text)
    ends = {a for a, b in found if b == ";"} | last["stmt"] | last["item"] | {"}"}
    starts = first["item"] | first["stmt"]
    plain = set(found)
    # an automatic semicolon before a closing brace and at the end
    plain |= {(a, b) for a in ends for b in ("}", "EOF")} | {(a, b) for a in ("}", ")") for b in starts}
    for a, b in plain:
        for x in (a, js.NL + a):
            add("javascript", x, b)
            add("javascript", x, js.NL + b)
    for a in ends:
        for b in starts - {";"}:
            for x in (a, js.NL + a):
                add("javascript", x, js.NL + b)
        # class fields end at a line end, too
        for b in first["member"]:
            for x in (a, js.NL + a):
                add("javascript", x, js.NL + b)
    return sorted(set(out))

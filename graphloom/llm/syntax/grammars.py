"""Grammars of the languages as EBNF over token kinds; groups name the symbol their content derives from."""

from __future__ import annotations

from functools import cache

from graphloom.llm.syntax import lexers
from graphloom.llm.syntax.chart import Grammar


def _any(words: frozenset[str]) -> str:
    return " | ".join(f"'{w}'" for w in sorted(words))


_JS = """
program := item*
item := stmt | 'import' importrest eos | 'export' exportrest
importrest := STR withattr? | TYPEONLY clause 'from' STR withattr? | name '=' expr
withattr := 'with' {<object>
clause := name | {<specs> | '*' 'as' name | name ',' {<specs> | name ',' '*' 'as' name
specs := (spec (',' spec)* ','?)?
spec := TYPEONLY (key | STR) ('as' (key | STR))?
exportrest := decl | {<specs> ('from' STR withattr?)? eos | '*' ('as' key)? 'from' STR withattr? eos | 'default' (funcdecl | classdecl | assign eos) | EXPORTTS
decl := vardecl eos | funcdecl | classdecl | TSDECL
stmts := item*
stmt := {<stmts> | ';' | vardecl eos | funcdecl | classdecl | 'if' (<expr> stmt ('else' stmt)? | 'for' 'await'? (<forhead> stmt | 'while' (<expr> stmt
    | 'do' stmt ';'? 'while' (<expr> eos | 'return' expr? eos | 'throw' expr eos | 'break' name? eos | 'continue' name? eos | 'debugger' eos
    | 'try' {<stmts> ('catch' (<binding>? {<stmts>)? ('finally' {<stmts>)? | 'switch' (<expr> {<cases> | name ':' stmt | 'with' (<expr> stmt | expr eos | TSDECL
cases := (('case' expr | 'default') ':' item*)* ';'*
eos := ';' | ENDMARK
vardecl := ('let' | 'const' | 'var') declarator (',' declarator)*
declarator := target BANG ANN ('=' assign)?
target := name | [<pattern> | {<objpattern>
binding := target ANN
pattern := ','* (pelem (','+ pelem)* ','*)?
pelem := '...'? target ('=' assign)?
objpattern := (oelem (',' oelem)* ','?)?
oelem := name ('=' assign)? | key ':' target ('=' assign)? | '...' name
forhead := (vardecl | expr)? ';' expr? ';' expr? | ('let' | 'const' | 'var')? (target | postfix) ('of' assign | 'in' expr)
funcdecl := 'async'? 'function' '*'? name? TPARAMS (<params> RET ({<stmts> | NOBODY)
params := (param (',' param)* ','?)?
param := decorator* MODS '...'? target OPT ANN ('=' assign)? | THISPARAM
decorator := '@' name ('.' key)* (<args>? ';'?
classdecl := decorator* ABSTRACT 'class' name? TPARAMS ('extends' postfix TARGS)? IMPLEMENTS {<members>
members := member*
member := ';' | decorator* MMODS (key OPT TPARAMS (<params> RET ({<stmts> ';'? | MNOBODY) | ('get' | 'set') key (<params> RET ({<stmts> | MNOBODY) | 'async' key TPARAMS (<params> RET {<stmts>
    | 'async'? '*' key TPARAMS (<params> RET {<stmts> | key OPTBANG ANN ('=' assign)? eos) | 'static' {<stmts> | INDEXMEMBER
expr := assign (',' assign)*
assign := cond | postfix ('=' | ASSIGN) assign | [<pattern> '=' assign | {<objpattern> '=' assign | 'yield' ('*'? assign)? | arrow
arrow := 'async'? (name | TPARAMS (<params> RET) '=>' ({<stmts> | assign)
cond := bin ('?' assign ':' assign)?
bin := unary (binop unary)*
binop := BIN | '+' | '-' | '*' | '/' | '<' | '>' | '>' '>' | '>' '>' '>' | '&' | '|' | 'in'
unary := ('!' | '~' | '+' | '-' | 'typeof' | 'void' | 'delete' | 'await' | '++' | '--') unary | postfix ('++' | '--')? CAST
postfix := primary suffix*
suffix := '.' key | '?.' key | '?.' (<args> | '?.' [<expr> | (<args> | [<expr> | TPL `<expr>* TSSUFFIX
primary := name | NUM | STR | TPL `<expr>* | RE | 'this' | 'super' | 'null' | 'true' | 'false' | [<elems> | {<object> | (<expr> | 'async'? 'function' '*'? name? TPARAMS (<params> RET {<stmts>
    | decorator* 'class' name? TPARAMS ('extends' postfix TARGS)? IMPLEMENTS {<members> | 'new' newtarget | 'new' '.' name | 'import' (<args> | 'import' '.' name
newtarget := primary ('.' key | [<expr>)* TARGS (<args>? | 'new' newtarget
args := (arg (',' arg)* ','?)?
arg := '...'? assign
elems := ','* (arg (','+ arg)* ','*)?
object := (prop (',' prop)* ','?)?
prop := key ':' assign | name ('=' assign)? | '...' assign | ('get' | 'set')? key (<params> RET {<stmts> | 'async'? '*'? key TPARAMS (<params> RET {<stmts>
key := NAME | KEYWORD | STR | NUM | [<expr>
name := NAME | CONTEXT
"""

_JS_ONLY = {"ANN": "none", "RET": "none", "OPT": "none", "BANG": "none", "OPTBANG": "none", "TPARAMS": "none", "TARGS": "none", "MODS": "none", "CAST": "none", "TYPEONLY": "none", "ABSTRACT": "none", "IMPLEMENTS": "none", "MMODS": "'static'?",
            "NOBODY": "never", "MNOBODY": "never", "THISPARAM": "never", "INDEXMEMBER": "never", "TSDECL": "never", "EXPORTTS": "never", "TSSUFFIX": ""}
_TS_ONLY = {"ANN": "(':' type)?", "RET": "(':' rettype)?", "OPT": "'?'?", "BANG": "'!'?", "OPTBANG": "('?' | '!')?", "TPARAMS": "tparams?", "TARGS": "targs?", "MODS": "modifier*", "CAST": "(('as' | 'satisfies') (type | 'const'))*", "TYPEONLY": "'type'?",
            "ABSTRACT": "'abstract'?", "IMPLEMENTS": "('implements' type (',' type)*)?", "MMODS": "modifier*", "NOBODY": "eos", "MNOBODY": "eos", "THISPARAM": "'this' ':' type", "INDEXMEMBER": "modifier* [<indexsig> ':' type eos", "TSDECL": "tsdecl", "EXPORTTS": "'=' expr eos | 'as' 'namespace' name eos", "TSSUFFIX": "| '!' | targs (<args>"}
_TS = """
tparams := '<' tparam (',' tparam)* ','? '>'
tparam := ('const' | 'in')? name ('extends' type)? ('=' type)?
targs := '<' type (',' type)* '>'
modifier := 'accessor' | 'public' | 'private' | 'protected' | 'static' | 'readonly' | 'override' | 'abstract' | 'declare'
rettype := type | 'asserts'? (name | 'this') 'is' type | 'asserts' (name | 'this')
type := utype ('extends' utype '?' type ':' type)? | TPARAMS (<params> '=>' rettype | 'abstract'? 'new' TPARAMS (<params> '=>' type
utype := ('|' | '&')? ptype (('|' | '&') ptype)*
ptype := ('keyof' | 'readonly' | 'unique' | 'infer') ptype | tprim ([<tindex>)*
tprim := name ('.' key)* targs? | STR | NUM | '-' NUM | TPL `<type>* | 'null' | 'void' | 'this' | 'true' | 'false' | 'typeof' (name | 'import' (<args>) ('.' key)* targs? | {<typebody> | [<tuple> | (<type> | 'import' (<args> ('.' key)* targs?
tindex := type?
tuple := (telem (',' telem)* ','?)?
telem := '...'? type '?'? | '...'? name '?'? ':' type
typebody := tmember* | ('+' | '-')? 'readonly'? [<mapped> (('+' | '-')? '?')? ':' type ';'?
tmember := 'readonly'? key '?'? (':' type)? tsep | key '?'? TPARAMS (<params> (':' rettype)? tsep | ('get' | 'set') key (<params> (':' type)? tsep | 'new'? TPARAMS (<params> (':' rettype)? tsep | 'readonly'? [<indexsig> '?'? ':' type tsep
tsep := ';' | ',' | ENDMARK
mapped := name 'in' type ('as' type)?
indexsig := name ':' type
tsdecl := 'type' name TPARAMS '=' type eos | 'interface' name TPARAMS ('extends' type (',' type)*)? {<typebody> | 'const'? 'enum' name {<enumbody> | 'declare' (tsdecl | vardecl eos | funcdecl | classdecl | 'global' {<stmts>) | ('namespace' | 'module') (name ('.' name)* | STR) {<stmts> | 'abstract' classdecl
enumbody := (key ('=' assign)? (',' key ('=' assign)?)* ','?)?
"""

_JAVA = """
program := item*
item := annotations 'package' qname ';' | 'import' 'static'? qname ('.' '*')? ';' | typedecl | ';' | 'open'? 'module' qname {<moduleb>
moduleb := (name qname (('to' | 'with') qname (',' qname)*)? ';')*
qname := name ('.' name)*
name := NAME | CONTEXT
annotations := annotation*
annotation := '@' qname (<annargs>?
annargs := (annarg (',' annarg)* ','?)?
annarg := (name '=')? elemval
elemval := cond | {<elemvals> | annotation
elemvals := (elemval (',' elemval)* ','?)?
mods := (annotation | 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed')*
typedecl := mods ('class' name tparams? ('extends' type)? ('implements' types)? ('permits' types)? {<members> | 'interface' name tparams? ('extends' types)? ('permits' types)? {<members> | 'enum' name ('implements' types)? {<enumbody>
    | 'record' name tparams? (<params> ('implements' types)? {<members> | '@' 'interface' name {<members>)
types := type (',' type)*
enumbody := (constant (',' constant)* ','?)? (';' member*)?
constant := annotations name (<args>? {<members>?
members := member*
member := ';' | typedecl | 'static'? {<stmts> | method | field | mods tparams? name ((<params>)? throws? {<stmts>
method := mods tparams? annotations (type | 'void') name (<params> dims throws? ({<stmts> | ('default' elemval)? ';')
throws := 'throws' types
field := mods type vars ';'
vars := var (',' var)*
var := name dims ('=' init)?
init := expr | {<inits>
inits := (init (',' init)* ','?)?
dims := (annotations [<none>)*
params := (param (',' param)* ','?)?
param := mods type annotations '...'? (name '.')? (name | 'this') dims | name
tparams := '<' tparam (',' tparam)* '>'
tparam := annotations name ('extends' type ('&' type)*)?
type := annotations (primitive | name targs? ('.' annotations name targs?)*) dims
primitive := 'int' | 'long' | 'short' | 'byte' | 'char' | 'boolean' | 'float' | 'double'
targs := '<' (targ (',' targ)*)? '>'
targ := annotations (type | '?' (('extends' | 'super') type)?)
stmts := stmt*
stmt := {<stmts> | ';' | mods type vars ';' | mods 'var' name '=' expr ';' | typedecl | expr ';' | 'if' (<expr> stmt ('else' stmt)? | 'for' (<forhead> stmt | 'while' (<expr> stmt | 'do' stmt 'while' (<expr> ';'
    | 'try' ((<resources>)? {<stmts> ('catch' (<catchp> {<stmts>)* ('finally' {<stmts>)? | 'switch' (<expr> {<cases> | 'return' expr? ';' | 'throw' expr ';' | 'break' name? ';' | 'continue' name? ';' | 'yield' expr ';'
    | 'synchronized' (<expr> {<stmts> | 'assert' expr (':' expr)? ';' | name ':' stmt
forhead := (mods type vars | exprs)? ';' expr? ';' exprs? | mods type name ':' expr
exprs := expr (',' expr)*
resources := resource (';' resource)* ';'?
resource := mods type name '=' expr | postfix
catchp := mods type ('|' type)* name
cases := (caselabel ':' stmt* | caselabel '->' (expr ';' | {<stmts> | 'throw' expr ';'))*
caselabel := 'case' caseval (',' caseval)* ('when' expr)? | 'default'
caseval := cond | 'default' | mods type name | type (<patterns>
patterns := (pat (',' pat)*)?
pat := mods type name | type (<patterns>
expr := cond | postfix ('=' | ASSIGN | '>' ASSIGN) expr | lambda
lambda := (name | (<lparams>) '->' (expr | {<stmts>)
lparams := params
cond := bin ('?' expr ':' (cond | lambda))?
bin := unary (binop unary | 'instanceof' (mods type name? | type (<patterns>))*
binop := BIN | '+' | '-' | '*' | '&' | '|' | '<' | '>' | '>' '>' | '>' '>' '>'
unary := ('+' | '-' | '!' | '~' | '++' | '--') unary | (<casttype> (unary | lambda) | postfix ('++' | '--')*
casttype := type ('&' type)*
postfix := primary suffix*
suffix := '.' name | '.' targs? name (<args> | '.' targs? 'new' name targs? (<args> {<members>? | '.' 'this' | '.' 'class' | '.' 'super' | [<expr> | '::' targs? (name | 'new')
primary := name | name (<args> | NUM | STR | 'true' | 'false' | 'null' | 'this' | 'super' | ('this' | 'super') (<args> | (<expr> | 'new' creator | (primitive | 'void') dims '.' 'class' | primitive dims '::' 'new' | name targs '::' (name | 'new') | 'switch' (<expr> {<cases> | name ('.' name)* [<none> ([<none>)* ('.' 'class' | '::' 'new')
creator := annotations (primitive | name targs? ('.' name targs?)*) ((<args> {<members>? | [<none> ([<none>)* {<inits> | [<expr> ([<expr> | [<none>)*)
args := (expr (',' expr)*)?
none := annotations
"""

_GO = """
program := item*
item := 'package' NAME eos | 'import' (STR | importspec | (<imports>) eos | decl eos | funcdecl eos
imports := (importspec eos)*
importspec := ('.' | NAME)? STR
eos := ';' | ENDMARK
decl := 'const' (constspec | (<consts>) | 'var' (varspec | (<vars>) | 'type' (typespec | (<types>)
consts := (constspec eos)*
constspec := names type? ('=' exprs)?
vars := (varspec eos)*
varspec := names (type ('=' exprs)? | '=' exprs)
types := (typespec eos)*
typespec := NAME ([<tparams>)? '='? type
tparams := tparam (',' tparam)* ','?
tparam := names constraint
constraint := ('~'? type) ((BIN | '|') '~'? type)*
names := NAME (',' NAME)*
funcdecl := 'func' ((<params>)? NAME ([<tparams>)? sig {<stmts>? 
sig := (<params> result?
result := type | (<params>
params := (param (',' param)* ','?)?
param := NAME? '...'? type | NAME
type := NAME ('.' NAME)? ([<typeargs>)? | '*' type | [<arraylen> type | 'map' [<type> type | 'chan' '<-'? type | '<-' 'chan' type | 'func' sig | 'struct' {<fields> | 'interface' {<methods> | (<type>
typeargs := type (',' type)* ','?
arraylen := (expr | '...')?
fields := (field STR? eos)*
field := names type | '*'? NAME ('.' NAME)? ([<typeargs>)?
methods := ((NAME sig | constraint) eos)*
stmts := stmt*
stmt := ';' | simple eos | decl eos | 'return' exprs? eos | 'break' NAME? eos | 'continue' NAME? eos | 'goto' NAME eos | 'fallthrough' eos | {<stmts> eos | ifstmt eos | 'for' forhead? {<stmts> eos | 'switch' (simple? ';')? switchon? {<cases> eos | 'select' {<comms> eos | ('go' | 'defer') expr eos | NAME ':' stmt | NAME ':' ENDMARK
ifstmt := 'if' (simple? ';')? expr {<stmts> ('else' (ifstmt | {<stmts>))?
forhead := expr | simple? ';' expr? ';' simple? | (exprs ('=' | ':='))? 'range' expr
switchon := expr | (NAME ':=')? postfix '.' (<kwtype>
kwtype := 'type'
cases := (('case' caseitems | 'default') ':' stmt*)*
caseitems := caseitem (',' caseitem)*
caseitem := expr | type
comms := (('case' (simple | (exprs ('=' | ':='))? '<-' unary) | 'default') ':' stmt*)*
simple := expr ('++' | '--')? | exprs ('=' | ':=' | ASSIGN) exprs | expr '<-' expr
exprs := expr (',' expr)*
expr := unary (binop unary)*
binop := BIN | '+' | '-' | '*' | '&' | '|' | '^'
unary := ('+' | '-' | '!' | '^' | '*' | '&' | '<-') unary | postfix
postfix := primary suffix*
suffix := '.' NAME | '.' (<assertion> | [<index> | (<args>
assertion := type | 'type'
index := expr (',' expr)* ','? | expr? ':' expr? (':' expr)? | typeargs
args := (arg (',' arg)* ','?)?
arg := expr '...'? | type
primary := NAME | NUM | STR | (<expr> | 'func' sig {<stmts> | littype {<lit> | [<arraylen> type (<args> | (<type> | ('map' [<type> type | 'chan' type | 'interface' {<methods>) (<args>
littype := NAME ('.' NAME)? ([<typeargs>)? | [<arraylen> type | 'map' [<type> type | 'struct' {<fields>
lit := (element (',' element)* ','? ';'?)?
element := (value ':')? value
value := expr | {<lit>
"""

_PYTHON = """
program := stmt*
suite := stmt*
stmt := simple (';' simple)* ';'? NEWLINE | compound
body := simple (';' simple)* ';'? NEWLINE | NEWLINE {<suite>
compound := 'if' named ':' body ('elif' named ':' body)* ('else' ':' body)? | 'while' named ':' body ('else' ':' body)? | 'async'? 'for' stargets 'in' stars ':' body ('else' ':' body)?
    | 'try' ':' body (('except' '*'? (expr (',' expr)* ('as' name)?)? ':' body)+ ('else' ':' body)? ('finally' ':' body)? | 'finally' ':' body) | 'async'? 'with' withitems ':' body
    | decorated | 'match' stars ':' NEWLINE {<cases>
decorated := ('@' named NEWLINE)* ('async'? 'def' name ([<tparams>)? (<params> ('->' stars)? ':' body | 'class' name ([<tparams>)? ((<args>)? ':' body)
tparams := tparam (',' tparam)* ','?
tparam := ('*' | '**')? name (':' expr)? ('=' expr)?
withitems := withitem (',' withitem)* ','? | (<withgroup>
withgroup := withitem (',' withitem)* ','?
withitem := expr ('as' starget)?
cases := ('case' patterns ('if' named)? ':' body)+
patterns := orpat (',' orpat)* ','? | '*' name ','? (orpat ',')*
orpat := pat ('|' pat)* ('as' name)?
pat := ('-' )? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | name ('.' name)* ((<patargs>)? | [<patlist> | (<patlist> | {<patmap>
patlist := (('*'? orpat) (',' ('*'? orpat))* ','?)?
patargs := ((name '=')? orpat (',' (name '=')? orpat)* ','?)?
patmap := (patkey (',' patkey)* ','?)?
patkey := (STR+ | '-'? NUM | name ('.' name)+ | 'None' | 'True' | 'False') ':' orpat | '**' name
simple := stars | stargets '=' assigned | stargets ASSIGN (yieldexpr | stars) | starget ':' expr ('=' assigned)? | 'pass' | 'break' | 'continue' | 'return' stars? | 'raise' (expr ('from' expr)?)? | 'global' name (',' name)* | 'nonlocal' name (',' name)*
    | 'del' stargets | 'assert' expr (',' expr)? | 'import' dotted ('as' name)? (',' dotted ('as' name)?)* | 'from' ('.' | '...')* dotted? 'import' ('*' | aliases | (<aliases>) | yieldexpr | 'type' name ([<tparams>)? '=' expr
assigned := yieldexpr | stars | stargets '=' assigned
dotted := name ('.' name)*
aliases := name ('as' name)? (',' name ('as' name)?)* ','?
yieldexpr := 'yield' ('from' expr | stars)?
stargets := starget (',' starget)* ','?
starget := '*'? postfix
stars := star (',' star)* ','?
star := '*' bitor | named
named := name ':=' expr | expr
expr := disj ('if' disj 'else' expr)? | 'lambda' lparams ':' expr
lparams := (lparam (',' lparam)* ','?)?
lparam := name ('=' expr)? | '*' name? | '**' name | '/'
disj := conj (('and' | 'or') conj)*
conj := 'not' conj | comparison
comparison := bitor (compop bitor)*
compop := CMP | 'in' | 'not' 'in' | 'is' | 'is' 'not'
bitor := unary (arith unary)*
arith := BIN | '+' | '-' | '*' | '**' | '|' | '@' | '/'
unary := ('+' | '-' | '~') unary | 'await'? postfix
postfix := primary suffix*
suffix := '.' name | (<args> | [<slices>
primary := name | NUM | (STR `<fexpr>*)+ | 'None' | 'True' | 'False' | '...' | (<parens> | [<listing> | {<dict>
fexpr := yieldexpr | stars
parens := (yieldexpr | star comp | stars)?
listing := (star comp | stars)?
dict := (ditem (',' ditem)* ','?)? | expr ':' expr comp | star comp | star (',' star)* ','?
ditem := expr ':' expr | '**' bitor
comp := ('async'? 'for' stargets 'in' disj ('if' condition)*)+
condition := name ':=' expr | disj
args := (arg (',' arg)* ','?)? | named comp
arg := named | name '=' expr | '*' expr | '**' expr
slices := slice (',' slice)* ','?
slice := named | '*' bitor | expr? ':' expr? (':' expr?)?
params := (pparam (',' pparam)* ','?)?
pparam := name (':' expr)? ('=' expr)? | '*' (name (':' star)?)? | '**' name (':' expr)? | '/'
name := NAME | CONTEXT
"""

_JSON = """
program := value
value := STR | NUM | 'true' | 'false' | 'null' | [<elems> | {<members>
elems := (value (',' value)*)?
members := (STR ':' value (',' STR ':' value)*)?
"""


def _fill(text: str, words: dict[str, str]) -> str:
    import re

    for k, v in words.items():
        text = re.sub(rf"\b{k}\b", lambda m, v=v: v if v in ("none", "never", "") else f"({v})" if not v.startswith("|") else v, text)
    return text


@cache
def grammar(language: str) -> Grammar:
    """The grammar of a language; symbol ``program`` derives a whole file."""
    if language in ("javascript", "typescript"):
        text = _JS + (_TS if language == "typescript" else "")
        text = _fill(text, _TS_ONLY if language == "typescript" else _JS_ONLY) + "\nnone := \nnever := 'NEVER'\n"
        text = _fill(text, {"KEYWORD": _any(lexers.JS_KEYWORDS | lexers.JS_CONTEXT), "CONTEXT": _any(lexers.JS_CONTEXT)})
        follow = frozenset(["else", "catch", "finally", "while", ".", "?.", ",", ";", "=", "?", ":", ")", "=>", "as", "from", "BIN", "ASSIGN", "+", "-", "*", "/", "<", ">", "&", "|", "in", "of", "TPL", "!", "satisfies", "ENDMARK", "with"])
        return Grammar(text, {"program": "item", "stmts": "item", "members": "member"}, follow)
    if language == "java":
        text = _fill(_JAVA, {"CONTEXT": _any(lexers.JAVA_CONTEXT)}).replace("'to'", "NAME").replace("'with'", "NAME").replace("'open'?", "")
        return Grammar(text, {"program": "item", "members": "member", "stmts": "stmt"}, frozenset(["else", "catch", "finally", "while", ".", ",", ";", ")", "::", "BIN", "+", "?", ":"]))
    if language == "go":
        return Grammar(_GO, {"program": "item", "stmts": "stmt"}, frozenset(["else", ";", ",", ".", ")", ":", "BIN", "+", "-", "*", "&", "|", "=", ":=", "<-"]))
    if language == "python":
        return Grammar(_fill(_PYTHON, {"CONTEXT": _any(lexers.PY_CONTEXT), "CMP": "BIN"}), {"program": "stmt", "suite": "stmt"}, frozenset(["elif", "else", "except", "finally", "NEWLINE", ":", ",", ")"]), "NEWLINE")
    return Grammar(_JSON)

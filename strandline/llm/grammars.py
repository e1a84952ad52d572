"""The grammars of six languages, over the kinds of functions.lexing. See peg for the notation."""

from __future__ import annotations

from functools import cache

from ..functions import lexing as lx
from .peg import Grammar

PYTHON = r"""
file <- stmt* EOF
stmt ~ compound / simple
block <- NEWLINE INDENT stmt+ DEDENT / simple
simple = small (';' small)* ';'? NEWLINE
small = 'return' exprs? / 'pass' / 'break' / 'continue' / 'raise' (expr ('from' expr)?)? / import / 'del' targets !';x' / 'assert' expr (',' expr)?
  / ('global' / 'nonlocal') ID (',' ID)* / 'type' ID tparams? '=' expr / assignment
import = 'import' dotted ('as' ID)? (',' dotted ('as' ID)?)* / 'from' (('.' / '...')* dotted / ('.' / '...')+) 'import' ('*' / '(' alias (',' alias)* ','? ')' / alias (',' alias)*)
-- what has no brackets within brackets, up to where an expression ends, is one pattern
fatom = ID / NUMBER / STRING / BYTES / 'None' / 'True' / 'False'
fbin = '+' / '-' / '*' / '/' / '//' / '%' / '@' / '&' / '|' / '^' / '<<' / '>>' / '**' / '==' / '!=' / '<=' / '<' / '>=' / '>' / 'in' / 'is' / 'and' / 'or'
f0 = fatom ('.' ID)*
e0 = f0 (fbin f0)*
f1 = fatom ('.' ID / '(' (e0 (',' e0)*)? ')' / '[' e0 ']')*
flat = f1 (fbin f1)* &(',' / ')' / ']' / ':' / NEWLINE / '}' / ';')
literals = ((NUMBER / STRING / BYTES) ',')+
dotted = ID ('.' ID)*
alias = ID ('as' ID)?
assignment <- (targets '=')+ (yield / exprs) !'=' / target augop (yield / exprs) / (target / '(' target ')') ':' expr ('=' (yield / exprs))? / exprs !'=' / yield
augop = '+=' / '-=' / '*=' / '/=' / '//=' / '%=' / '@=' / '&=' / '|=' / '^=' / '>>=' / '<<=' / '**='
targets <- ID ('.' ID)* &'=' / star_target (',' star_target)* ','?
star_target = '*'? target
target <- base (suffix &more)* (('.' ID / '[' slices ']')) !more / ID !more / '(' (star_target (',' star_target)* ','?)? ')' !more / '[' (star_target (',' star_target)* ','?)? ']' !more
base = atom &more
more = '(' / '[' / '.'
compound = decorated / classdef / function / if / 'while' named ':' block else? / for / with / try / match
decorated = ('@' named NEWLINE)+ (classdef / function)
name := ID
function := 'async'? 'def' name tparams? '(' params? ')' ('->' expr)? ':' block
classdef := 'class' name tparams? ('(' !(named comp) args? ')')? ':' block
if = 'if' named ':' block ('elif' named ':' block)* else?
else = 'else' ':' block
for = 'async'? 'for' targets 'in' exprs ':' block else?
with = 'async'? 'with' ('(' withitem (',' withitem)* ','? ')' ':' / withitem (',' withitem)* ':') block
withitem = expr ('as' star_target)?
try = 'try' ':' block (('except' '*'? (expr (',' expr)* ('as' ID)?)? ':' block)+ else? ('finally' ':' block)? / 'finally' ':' block)
match = 'match' subject ':' NEWLINE INDENT ('case' patterns ('if' named)? ':' block)+ DEDENT
subject = star_named (',' star_named)* ','?
patterns = star_pattern (',' star_pattern)* ','?
star_pattern = '*' ID / pattern
pattern <- closed ('|' closed)* ('as' ID)?
closed <- '-'? NUMBER (('+' / '-') NUMBER)? / strings / 'None' / 'True' / 'False' / dotted ('(' (argpat (',' argpat)* ','?)? ')')? / '(' (patterns)? ')' / '[' patterns? ']' / '{' (mappat (',' mappat)* ','?)? '}'
argpat = ID '=' pattern / pattern
mappat = '**' ID / (strings / '-'? NUMBER (('+' / '-') NUMBER)? / 'None' / 'True' / 'False' / dotted) ':' pattern
tparams = '[' tparam (',' tparam)* ','? ']'
tparam = ('*' / '**')? ID (':' expr)? ('=' expr)?
params = (nparams (',' dparams (',' '/' (',' dparams)?)? / ',' '/' (',' (nparams (',' dparams)? / dparams))?)? / dparams (',' '/' (',' dparams)?)?) (',' starparams)? ','? / starparams ','?
nparams = nparam (',' nparam)*
dparams = dparam (',' dparam)*
nparam = ID (':' expr)? !'='
dparam = ID (':' expr)? '=' expr
param = ID (':' expr)? ('=' expr)?
starparams = '*' (ID (':' '*'? expr)?) (',' param)* (',' kwparam)? / '*' (',' param)+ (',' kwparam)? / kwparam
kwparam = '**' ID (':' expr)?
lparams = (lnames (',' ldefaults (',' '/' (',' ldefaults)?)? / ',' '/' (',' (lnames (',' ldefaults)? / ldefaults))?)? / ldefaults (',' '/' (',' ldefaults)?)?) (',' lstar)? ','? / lstar ','?
lnames = ID !'=' (',' ID !'=')*
ldefaults = ID '=' expr (',' ID '=' expr)*
lparam = ID ('=' expr)?
lstar = '*' ID (',' lparam)* (',' '**' ID)? / '*' (',' lparam)+ (',' '**' ID)? / '**' ID
exprs <- star_named_or (',' star_named_or)* ','?
star_named_or = '*' arith / expr
star_named = '*' arith / named
named <- flat / ID ':=' expr / expr !':='
yield = 'yield' ('from' expr / exprs)?
expr <- flat / 'lambda' lparams? ':' expr / disj ('if' disj 'else' expr)?
disj <- inversion (('and' / 'or') inversion)*
inversion = 'not'* comparison
comparison = arith (compop arith)*
compop = '==' / '!=' / '<=' / '<' / '>=' / '>' / 'in' / 'not' 'in' / 'is' 'not'?
arith <- unary (('+' / '-' / '*' / '/' / '//' / '%' / '@' / '&' / '|' / '^' / '<<' / '>>' / '**') unary)*
unary = ('+' / '-' / '~')* 'await'? primary
primary <- atom suffix*
suffix = '.' ID / '(' args? ')' / '[' slices ']'
slices = slice (',' slice)* ','?
slice = '*' arith / (named? ':' expr? (':' expr?)?) / named
args <- named comp &')' / placed (',' placed)* (',' keyed)? ','? / keyed ','?
placed = '*' expr / !(ID '=') named !'for' !'async'
keyed = (keyword / '*' expr) (',' (keyword / '*' expr))* (',' doubled)? / doubled
doubled = '**' expr (',' ('**' expr / keyword))*
keyword = ID '=' expr
comp <- ('async'? 'for' targets 'in' disj ('if' disj_or_lambda)*)+
disj_or_lambda = ID ':=' expr / disj
atom <- ID / NUMBER / strings / 'None' / 'True' / 'False' / '...' / '(' (yield / star_named comp / star_named (',' star_named)* ','?)? ')' / '[' (literals (star_named (',' star_named)* ','?)? / star_named comp / star_named (',' star_named)* ','?)? ']' / dict
dict = '{' (pair comp / pair (',' pair)* ','? / star_named comp / star_named (',' star_named)* ','?)? '}'
pair = '**' arith / expr ':' expr
strings <- (STRING / FSTART field* FEND)+ / BYTES+
field <- FOPEN (yield / star_named (',' star_named)* ','?) FCONV? (FSPEC field*)? FCLOSE
"""

SCRIPT = r"""
file <- item* EOF
item = @IMPORTS@ stmt
stmt ~ '{' stmt* '}' / declaration / 'if' '(' expr ')' stmt ('else' stmt)? / 'for' 'await'? '(' forhead ')' stmt / 'while' '(' expr ')' stmt / 'do' stmt 'while' '(' expr ')' ';'?
  / 'return' (!^ expr)? end / 'throw' !^ expr end / 'break' (!^ ID)? end / 'continue' (!^ ID)? end / 'try' body ('catch' ('(' binding @ANN@ ')')? body ('finally' body)? / 'finally' body)
  / 'switch' '(' expr ')' '{' (('case' expr / 'default') ':' stmt*)* '}' / 'debugger' end / ';' / ID ':' stmt @WITH@ / !notexpr expr end
notexpr = 'function' / 'class' / '{' / 'async' !^ 'function' / 'let' '['
declaration = function / class / vars end @TSDECL@
vars <- 'const' @CONST@ (',' @CONST@)* / 'let' &(ID / '[' / '{') !'let' declarator (',' !'let' declarator)* / 'var' declarator (',' declarator)*
declarator = fdecl / ID '!'? @ANN@ ('=' assign)? / binding '!'? @ANN@ @PATTERN@
constant = !'let' (fdecl / binding @ANN@ '=' assign)
name := key
fdecl := name @ANN@ '=' &('function' / 'class' / 'async' / '(' / '<' / ID '=>') assign
end = ';' / &'}' / &EOF / ^
forhead <- ('var' / 'const' / 'let') binding ('of' assign / 'in' expr) / lhs ('of' assign / 'in' expr) / (vars / expr)? ';' expr? ';' expr?
function := @ASYNC@ 'function' '*'? name @TPARAMS@ '(' params ')' @RET@ (body @NOBODY@)
funcexpr := @ASYNC@ 'function' '*'? ID? @TPARAMS@ '(' params ')' @RET@ body
body <- '{' stmt* '}'
class := @DECO@ @ABSTRACT@ 'class' !'implements' &ID name classrest
defaultclass := @DECO@ @ABSTRACT@ 'class' (!'implements' &ID name)? classrest
classexpr := @DECO@ 'class' (!'implements' ID)? classrest
classrest = @TPARAMS@ ('extends' lhs @TARGS@)? @IMPLEMENTS@ '{' member* '}'
member <- ';' / @MEMBERMORE@ 'static' body / method / field
method := @DECO@ mods accessor? @OPTMARK@ @TPARAMS@ '(' params ')' @RET@ (body @NOBODY@)
mods = (@MODS@ &(key / '*' / MODWORD / '['))*
accessor = ('get' / 'set') !('(' / @LT@ '?x') name / ('async' !^)? '*' name / 'async' !^ !('(' / @LT@ '?x') name / name
field := @DECO@ mods ('accessor' &key)? name ('?' / '!')? @ANN@ ('=' assign)? end
key = IDN / STRING / NUMBER / PRIVATE / '[' assign ']'
params <- (param ',')* (@DECO@ '...' binding @ANN@ / param)?
param = @DECO@ @PMODS@ binding @QUEST@ @ANN@ ('=' assign)? @THISPARAM@
binding <- ID / '[' ','* (belem ','+)* (belem / '...' binding)? ']' / '{' (bprop ',')* (bprop / '...' binding)? '}'
belem = binding ('=' assign)?
bprop = key ':' binding ('=' assign)? / ID ('=' assign)?
fatom = ID / 'this' / NUMBER / STRING / 'null' / 'true' / 'false' / TEMPLATE / REGEX
fbin = '+' / '-' / '*' / '/' / '%' / '**' / '<<' / '<' / '<=' / '>=' / '==' / '!=' / '===' / '!==' / '&' / '|' / '^' / '&&' / '||' / '??' / 'instanceof' / '>'
f0 = fatom (('.' / '?.') IDN)*
e0 = f0 (fbin f0)*
f1 = fatom (('.' / '?.') IDN / '(' (e0 (',' e0)*)? ')' / '[' e0 ']')*
flat = f1 (fbin f1)* &(',' / ')' / ']' / ';' / '}' / ':')
expr <- assign (',' assign)*
assign <- flat / arrow / 'yield' (!^ '*'? assign)? / !((NUMBER / STRING / 'null' / 'true' / 'false' / 'this' / TEMPLATE / REGEX) asgop) lhs asgop assign / cond
asgop = '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '**=' / '<<=' / '>>=' / '>>>=' / '&=' / '|=' / '^=' / '&&=' / '||=' / '??='
arrow := ('async' !^)? (ID / @TPARAMS@ '(' params ')' @RET@) !^ '=>' (body / !'{' assign)
cond <- binary ('?' assign ':' assign)?
binary = unary (binop unary @AS@)*
binop = '+' / '-' / '*' / '/' / '%' / '**' / '<<' / '>' '>'? '>'? / '<' / '<=' / '>=' / '==' / '!=' / '===' / '!==' / '&' / '|' / '^' / '&&' / '||' / '??' / 'in' / 'instanceof'
unary <- @DELETE@ ('delete' / 'void' / 'typeof' / '+' / '-' / '~' / '!' / '++' / '--' / 'await' @CAST@) unary / PRIVATE 'in' lhs / lhs (!^ ('++' / '--'))?
lhs <- (new / primary) suffix*
new <- 'new' ('.' 'target' / (new / primary) newsuffix* @TARGS@ arguments?)
newsuffix = '.' (IDN / PRIVATE) / '[' expr ']' / template
suffix = '.' (IDN / PRIVATE) / '?.' (IDN / PRIVATE / '[' expr ']' / @TARGS@ arguments) / '[' expr ']' / arguments / template @TSSUFFIX@
arguments <- '(' (('...'? assign) (',' '...'? assign)* ','?)? ')'
template <- TEMPLATE / HEAD expr (MIDDLE expr)* TAIL
primary <- funcexpr / classexpr / ID / 'this' / 'super' / 'null' / 'true' / 'false' / NUMBER / STRING / REGEX / template / '(' expr ')' / array / object / 'import' ('(' assign (',' assign)? ','? ')' / '.' 'meta') / jsx
array <- '[' ','* ((NUMBER / STRING) ',')* ('...'? assign ','+)* ('...'? assign)? ']'
object <- '{' (prop ',')* prop? '}'
prop = '...' assign / objmethod / key ':' assign / ID ('=' assign)?
objmethod := accessor @TPARAMS@ '(' params ')' @RET@ body
jsx <- JOPEN (jname @JTARGS@ attr*)? (JSELF / JEND child* JCLOSE jname? JEND)
jname = JNAME (('.' / ':') JNAME)*
attr = JNAME (':' JNAME)? ('=' (STRING / '{' assign '}' / jsx))? / '{' '...' assign '}'
child <- JTEXT / '{' ('...'? expr)? '}' / jsx
"""
IMPORTS = r"""'import' !('(' / '.') (STRING / @TYPEKW@ clause 'from' STRING) ('with' object)? end @IMPORTEQ@ / 'export' (('*' ('as' (IDN / STRING))? 'from' STRING / @TYPEKW@ '{' (spec ',')* spec? '}' ('from' STRING)?) ('with' object)? end / 'default' (defaultfunc / defaultclass / @DEFAULTMORE@ !'class' assign end) / declaration @EXPORTMORE@) / @DECOEXPORT@"""
IMPORT_RULES = r"""
clause = (ID (',' (star / named))? / star / named)
star = '*' 'as' ID
named = '{' (spec ',')* spec? '}'
spec = @TYPEKW@ (IDN / STRING) ('as' (IDN / STRING))?
defaultfunc := @ASYNC@ 'function' '*'? (&ID name)? @TPARAMS@ '(' params ')' @RET@ (body @NOBODY@)
"""
TYPES = r"""
tparams = '<' (tparam (',' tparam)* ','?) '>'
tparam = ('const' / 'in' / 'out')* ID ('extends' type)? ('=' type)?
targs <- '<' type (',' type)* ','? '>'
type <- union ('extends' union '?' type ':' type)?
union <- ('|' / '&')? tprim (('|' / '&') tprim)*
tprim <- tparams? '(' tfparams ')' '=>' type / 'abstract'? 'new' tparams? '(' tfparams ')' '=>' type / ('keyof' / 'unique' / 'readonly') !(',' / ';' / ')' / '=' / '|' / '>') tprim / 'infer' ID ('extends' union !'?')? / 'asserts' !^ (ID / 'this') ('is' type)? / (ID / 'this') !^ 'is' type / tatom (!^ '[' type? ']')*
tatom = 'typeof' (ID / 'this' / 'import' '(' STRING ')') ('.' (IDN / PRIVATE))* (!^ targs)? / (ID / 'void' / 'this' / 'null' / 'true' / 'false' / 'import' '(' STRING ')') ('.' IDN)* (!^ targs)? / STRING / '-'? NUMBER / TEMPLATE / HEAD type (MIDDLE type)* TAIL / '(' type ')' / '[' (telem (',' telem)* ','?)? ']' / tobject
telem = '...'? (IDN '?'? ':' type / type '?'?)
tobject <- '{' mapped '}' / '{' (tmember ((';' / ',')+ / &'}' / &^))* '}'
mapped = (('+' / '-')? 'readonly')? '[' ID 'in' type ('as' type)? ']' (('+' / '-')? '?')? (':' type)? ';'?
tmember <- 'readonly'? '[' ID ':' type ']' ':' type / 'new'? tparams? '(' tfparams ')' ann? / ('get' / 'set') key '(' tfparams ')' ann? / ('readonly' &key)? key '?'? (tparams? '(' tfparams ')')? ann?
tfparams = (tfparam ',')* tfparam?
tfparam = '...'? (binding / 'this') '?'? ann?
ann = ':' type
interface := 'interface' ID tparams? ('extends' heritage (',' heritage)*)? tobject
heritage = lhs targs?
typealias = 'type' ID tparams? '=' type end
enum = 'const'? 'enum' ID '{' (enummember ',')* enummember? '}'
enummember = (IDN / STRING) ('=' assign)?
namespace <- ('namespace' / 'module') (ID ('.' ID)* / STRING) ('{' item* '}' / end) / 'global' '{' item* '}'
declare <- 'declare' (function / class / vars end / interface / typealias / enum / namespace)
decorator = '@' lhs
"""
TS = {
    "ANN": "ann?", "WITH": "", "TSDECL": "/ interface / typealias / enum / namespace / declare", "TPARAMS": "tparams?", "RET": "ann?", "NOBODY": "/ end", "DECO": "decorator*", "ABSTRACT": "'abstract'?", "TARGS": "targs?",
    "IMPLEMENTS": "('implements' heritage (',' heritage)*)?", "MEMBERMORE": "mods '[' ID ':' type ']' ann? end /", "OPTMARK": "('?' / '!')?", "MODS": "MODWORD", "PMODS": "('public' / 'private' / 'protected' / 'readonly' / 'override')*", "QUEST": "'?'?", "THISPARAM": "/ 'this' ann",
    "AS": "/ !^ ('as' / 'satisfies') ('const' / type)", "TSSUFFIX": "/ !^ '!' / targs (arguments / template)", "TYPEKW": "('type' !('from' STRING / ',' / '}' / 'as' IDN (',' / '}')))?", "IMPORTEQ": "/ 'import' 'type'? ID '=' ('require' '(' STRING ')' / ID ('.' IDN)*) end", "DEFAULTMORE": "interface /",
    "EXPORTMORE": "/ '=' expr end / 'as' 'namespace' ID end / 'import' ID '=' ('require' '(' STRING ')' / ID ('.' IDN)*) end", "DECOEXPORT": "decorator+ 'export' ('default' defaultclass / class) /", "JTARGS": "targs?", "LT": "'<' /", "CONST": "declarator", "PATTERN": "('=' assign)?",
}
JS = dict.fromkeys(TS, "") | {"MODS": "'static'", "LT": "", "CONST": "constant", "PATTERN": "'=' assign"}

JAVA = r"""
file <- modifiers? moduledecl EOF / (annotation* 'package' qualified ';')? ('import' 'static'? qualified ('.' '*')? ';' / ';')* (typedecl / ';')* EOF
moduledecl = 'open'? 'module' qualified '{' (('requires' ('transitive' / 'static')* qualified / ('exports' / 'opens') qualified ('to' qualified (',' qualified)*)? / 'uses' qualified / 'provides' qualified 'with' qualified (',' qualified)*) ';')* '}'
qualified = ID ('.' ID)*
modifiers = modifier+
modifier = annotation / 'public' / 'private' / 'protected' / 'static' / 'final' / 'abstract' / 'native' / 'synchronized' / 'transient' / 'volatile' / 'strictfp' / 'default' !(':' / '->') / 'sealed' &(MODWORD / 'class' / 'interface') / 'non' '-' 'sealed'
annotation <- '@' !'interface' qualified ('(' (elementpair (',' elementpair)* ','? / elementvalue)? ')')?
elementpair = ID '=' elementvalue
elementvalue <- annotation / '{' (elementvalue (',' elementvalue)*)? ','? '}' / ternary
typedecl <- modifier* (class / interface / enum / record / annotype)
name := ID
class := 'class' name tparams? ('extends' type)? ('implements' types)? ('permits' types)? classbody
classbody <- '{' member* '}'
interface := 'interface' name tparams? ('extends' types)? ('permits' types)? classbody
annotype := '@' 'interface' name '{' member* '}'
enum := 'enum' name ('implements' types)? '{' (constant (',' constant)*)? ','? (';' member*)? '}'
constant = annotation* ID arguments? classbody?
record := 'record' name tparams? '(' (modifier* type '...'? ID (',' modifier* type '...'? ID)*)? ')' ('implements' types)? classbody
types = type (',' type)*
member <- ';' / 'static'? block / typedecl / method / field
field = modifier* type declarators ';'
method := modifier* tparams? annotation* ('void' name / type name / name) ('(' params ')' dims ('throws' types)? ('default' elementvalue)? (block / ';') / block)
params <- (param (',' param)*)?
param = modifier* type annotation* '...'? ((ID '.')? 'this' / ID dims)
dims = (annotation* '[' ']')*
tparams = '<' tparam (',' tparam)* '>'
tparam = annotation* ID ('extends' type ('&' type)*)?
type <- annotation* (PRIMITIVE / ID targs? ('.' annotation* ID targs?)*) dims
targs <- '<' (targ (',' targ)*)? '>'
targ = annotation* '?' (('extends' / 'super') type)? / type
declarators = declarator (',' declarator)*
declarator = ID dims ('=' init)?
fatom = ID / 'this' / NUMBER / STRING / CHAR / 'null' / 'true' / 'false'
fbin = '+' / '-' / '*' / '/' / '%' / '<<' / '<' / '<=' / '>=' / '==' / '!=' / '&' / '|' / '^' / '&&' / '||' / '>'
f0 = fatom ('.' ID)*
e0 = f0 (fbin f0)*
f1 = fatom ('.' ID / '(' (e0 (',' e0)*)? ')' / '[' e0 ']')*
flat = f1 (fbin f1)* &(',' / ')' / ']' / ';' / '}')
init <- '{' ((NUMBER / STRING / CHAR) ',')* (init (',' init)*)? ','? '}' / expr
block <- '{' stmt* '}'
stmt ~ block / ';' / 'if' '(' expr ')' stmt ('else' stmt)? / 'for' '(' (modifier* type ID ':' expr / (localvar / expr (',' expr)*)? ';' expr? ';' (expr (',' expr)*)?) ')' stmt / 'while' '(' expr ')' stmt / 'do' stmt 'while' '(' expr ')' ';'
  / 'try' (('(' resource (';' resource)* ';'? ')') block catch* finally? / block (catch+ finally? / finally)) / switch !'.' / 'synchronized' '(' expr ')' block / 'return' expr? ';' / 'throw' expr ';' / 'break' ID? ';' / 'continue' ID? ';' / 'assert' expr (':' expr)? ';'
  / 'yield' !('=' / '.' / '(' / '++' / '--') expr ';' / ID ':' stmt / typedecl / localvar ';' / statementexpr ';'
statementexpr <- ('++' / '--') unary / lhs asgop expr / call
call <- primary (suffix &more)* ((callsuffix / '++' / '--') !more / ('++' / '--')) / 'new' creator !more / primary &'(' NEVER / callatom !more
callatom = ID arguments / ('this' / 'super') arguments / primary arguments
callsuffix = '.' targs? ID arguments / arguments / '.' 'new' creator / '.' targs? ('super' / 'this') arguments
more = '.' / '[' / '++' / '--' / '::' / '('
catch = 'catch' '(' modifier* type ('|' type)* ID ')' block
finally = 'finally' block
resource = modifier* type ID '=' expr / expr
localvar = modifier* type declarators
switch <- 'switch' '(' expr ')' '{' (label '->' (block / 'throw' expr ';' / expr ';'))+ '}' / 'switch' '(' expr ')' '{' ((label ':')+ stmt*)* '}'
label = 'default' / 'case' caseitem (',' caseitem)* ('when' ternary)?
caseitem = 'default' / pattern / ternary !'->x'
pattern <- modifier* type '(' (pattern (',' pattern)*)? ')' (!'when' ID)? / modifier* type ID
expr <- flat / lambda / lhs asgop expr / ternary
asgop = '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '>>>='
lambda <- (ID / '(' (ID (',' ID)*)? ')' / '(' params ')') '->' (block / expr)
ternary <- binary ('?' (lambda / ternary) ':' (lambda / ternary))?
binary = unary (binop unary / 'instanceof' ('final'? pattern / type))*
binop = '+' / '-' / '*' / '/' / '%' / '<<' / '>' '>'? '>'? / '<' / '<=' / '>=' / '==' / '!=' / '&' / '|' / '^' / '&&' / '||'
unary <- ('+' / '-' / '++' / '--' / '~' / '!') unary / cast / switch / lhs ('++' / '--')*
cast = '(' PRIMITIVE dims ')' unary / '(' type ('&' type)* ')' (lambda / ('~' / '!') unary / &CASTABLE unary)
lhs <- primary suffix*
suffix = '.' targs? ID arguments / '.' ID / '.' 'this' / '.' 'class' / '.' 'new' creator / '.' targs? 'super' arguments? / '[' expr ']' / '::' targs? (ID / 'new') / arguments
arguments <- '(' (expr (',' expr)*)? ')'
primary <- NUMBER / STRING / CHAR / 'true' / 'false' / 'null' / 'this' / 'super' / 'new' creator / PRIMITIVE dims ('.' 'class' / '::' 'new') / 'void' '.' 'class' / ID targs? dims '::' (ID / 'new') / ID ('.' ID)* ('[' ']')+ '.' 'class' / ID / '(' expr ')'
creator <- annotation* (PRIMITIVE / ID targs? ('.' ID targs?)*) (arguments classbody? / ('[' expr ']')+ dims / ('[' ']')+ '{' (init (',' init)*)? ','? '}')
"""

GO = r"""
file <- 'package' ID ';' ('import' (importspec / '(' (importspec ';')* importspec? ')') ';')* (topdecl ';')* topdecl? EOF
importspec = ('.' / ID)? STRING
topdecl = function / declaration
declaration <- 'const' (constspec / '(' (constspec ';')* constspec? ')') / 'var' (varspec / '(' (varspec ';')* varspec? ')') / 'type' (typespec / '(' (typespec ';')* typespec? ')')
constspec = ids (type? '=' exprs)?
varspec = ids (type ('=' exprs)? / '=' exprs)
typespec = ID (('[' tparam (',' tparam)* ','? ']') type / '='? type)
tparam = ID (',' ID)* constraint
constraint <- '~'? type ('|' '~'? type)*
ids = ID (',' ID)*
name := ID
receiver := '(' params ')'
function := 'func' receiver? name ('[' tparam (',' tparam)* ','? ']')? signature block?
signature = '(' params ')' result?
result = '(' params ')' / type
params <- (param (',' param)* ','?)?
param = ID '...'? type / '...'? type
type <- ID ('.' ID)? ('[' type (',' type)* ','? ']')? / '*' type / '[' ']' type / '[' ('...' / expr) ']' type / 'map' '[' type ']' type / 'chan' '<-'? type / '<-' 'chan' type / 'func' signature / struct / interface / '(' type ')'
struct = 'struct' '{' (fielddecl ';')* fielddecl? '}'
fielddecl = (ids type / '*'? ID ('.' ID)? ('[' type (',' type)* ']')?) STRING?
interface = 'interface' '{' (elem ';')* elem? '}'
elem = ID '(' params ')' result? / constraint
block <- '{' stmts '}'
stmts = (stmt ';' / ';')* stmt?
stmt ~ declaration / block / if / for / switch / select / 'return' exprs? / 'break' ID? / 'continue' ID? / 'goto' ID / 'fallthrough' / ('go' / 'defer') expr / ID ':' stmt? / simple
simple <- exprs (asgop exprs / ':=' ('range' expr / exprs) / '<-' expr / '++' / '--' / !('=' / ':=')) 
asgop = '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '&^='
if <- 'if' (hsimple? ';')? hexpr block ('else' (if / block))?
for = 'for' ('range' hexpr / hexprs ('=' / ':=') 'range' hexpr / hsimple? ';' hexpr? ';' hsimple? / hexpr)? block
switch = 'switch' (hsimple? ';')? (typeswitch / hsimple)? '{' (('case' exprs_or_types / 'default') ':' stmts)* '}'
typeswitch = (ID ':=')? hprimary_type
hprimary_type = hoperand (hsuffix !'.x')* 
exprs_or_types = (type !('(' / '.' / '{') &(',' / ':') / expr / type) (',' (type &(',' / ':') / expr / type))*
select = 'select' '{' (('case' simple / 'default') ':' stmts)* '}'
fatom = ID / NUMBER / STRING / CHAR
fbin = '+' / '-' / '*' / '/' / '%' / '&' / '|' / '^' / '<<' / '>>' / '&^' / '&&' / '||' / '==' / '!=' / '<' / '<=' / '>' / '>='
f0 = fatom ('.' ID)*
e0 = f0 (fbin f0)*
f1 = fatom ('.' ID / '(' (e0 (',' e0)*)? ')' / '[' e0 ']')*
flat = f1 (fbin f1)* &(',' / ')' / ']' / ';' / '}' / ':')
exprs <- expr (',' expr)*
expr <- flat / unary (binop unary)*
binop = '+' / '-' / '*' / '/' / '%' / '&' / '|' / '^' / '<<' / '>>' / '&^' / '&&' / '||' / '==' / '!=' / '<' / '<=' / '>' / '>='
unary <- ('+' / '-' / '!' / '^' / '*' / '&' / '<-') unary / primary
primary <- operand suffix*
suffix = '.' (ID / '(' ('type' / type) ')') / '(' (arg (',' arg)* '...'? ','?)? ')' / '[' index ']' / literal
index = expr? ':' expr? (':' expr)? / (type &(',' / ']') / expr / type) (',' type)* ','?
arg = expr / type
operand <- NUMBER / STRING / CHAR / 'func' signature block / ('[' ('...' / expr)? ']' type / 'map' '[' type ']' type / struct) (literal / '(' expr ')') / ID / '(' (expr / type) ')' / conversion
conversion = ('[' ']' type / 'chan' type / 'func' signature / interface) &'('
literal <- '{' ((NUMBER / STRING / CHAR) ',')* (keyed (',' keyed)* ','?)? '}'
keyed = (expr / literal) (':' (expr / literal))?
hsimple <- hexprs (asgop hexprs / ':=' hexprs / '<-' hexpr / '++' / '--' / !('=' / ':='))
hexprs = hexpr (',' hexpr)*
hexpr <- hunary (binop hunary)*
hunary <- ('+' / '-' / '!' / '^' / '*' / '&' / '<-') hunary / hprimary
hprimary <- hoperand hsuffix*
hoperand <- 'func' signature block / ('[' ('...' / expr)? ']' type / 'map' '[' type ']' type / struct) (literal / '(' expr ')') / NUMBER / STRING / CHAR / ID / '(' (expr / type) ')' / conversion
hsuffix = '.' (ID / '(' ('type' / type) ')') / '(' (arg (',' arg)* '...'? ','?)? ')' / '[' index ']'
"""

RUST = r"""
file <- ('#' '!' '[' tree* ']')* item* EOF
attr <- '#' '[' tree* ']' / '#' '!' '[' tree* ']'
tree <- '(' tree* ')' / '[' tree* ']' / '{' tree* '}' / LEAF
vis = 'pub' ('(' ('in' path / 'crate' / 'self' / 'super') ')')? / 'crate' !'::'
item <- attr* vis? (function / struct / enum / union / trait / impl / 'mod' ID (';' / '{' item* '}') / 'unsafe'? 'extern' STRING? '{' item* '}' / 'extern' 'crate' (ID / 'self') ('as' ID)? ';' / 'use' usetree ';' / 'type' ID generics? bounds? where? ('=' type where?)? ';'
  / 'const' !('fn' / 'unsafe' / 'async' / 'extern') ID ':' type ('=' expr)? ';' / 'static' 'mut'? ID ':' type ('=' expr)? ';' / 'macro_rules' '!' ID ('{' tree* '}' / '(' tree* ')' ';' / '[' tree* ']' ';') / macro)
macro = path '!' ('{' tree* '}' / ('(' tree* ')' / '[' tree* ']') ';')
usetree <- '{' (usetree (',' usetree)* ','?)? '}' / '*' / '::'? (ID ('::' ID)*) ('::' ('*' / '{' (usetree (',' usetree)* ','?)? '}') / 'as' ID)? / '::' ('*' / '{' (usetree (',' usetree)* ','?)? '}')
function := attr* vis? 'default'? 'const'? 'async'? 'unsafe'? ('extern' STRING?)? 'fn' name generics? '(' fnparams ')' ('->' type)? where? (block / ';')
fnparams = ((selfparam / fnparam) (',' fnparam)* ','?)?
selfparam = attr* ('&' LIFETIME?)? 'mut'? 'self' !'::' (':' type)?
fnparam = attr* ('...' / pattern ':' ('...' / type) / &('&' / '*' / ID) type)
generics <- '<' (gparam (',' gparam)* ','?)? '>'
gparam = attr* (LIFETIME (':' (LIFETIME ('+' LIFETIME)*)?)? / 'const' ID ':' type ('=' (block / '-'? NUMBER / ID))? / ID bounds? ('=' type)?)
bounds = ':' boundlist?
boundlist <- bound ('+' bound)* '+'?
bound = LIFETIME / '(' '?'? forlt? path ')' / '?'? '~'? 'const'? forlt? path
forlt = 'for' generics
where <- 'where' (wherepred (',' wherepred)* ','?)?
wherepred = LIFETIME bounds / forlt? type bounds
struct = attr* 'struct' ID generics? (where? '{' (fielddef (',' fielddef)* ','?)? '}' / '(' (attr* vis? type (',' attr* vis? type)* ','?)? ')' where? ';' / where? ';')
fielddef = attr* vis? ID ':' type
union = 'union' ID generics? where? '{' (fielddef (',' fielddef)* ','?)? '}'
enum = 'enum' ID generics? where? '{' (variant (',' variant)* ','?)? '}'
variant = attr* vis? ID ('{' (fielddef (',' fielddef)* ','?)? '}' / '(' (attr* vis? type (',' attr* vis? type)* ','?)? ')')? ('=' expr)?
name := ID
trait := 'unsafe'? 'auto'? 'trait' name generics? bounds? where? ('{' attr* item* '}' / '=' boundlist where? ';')
self_type := type
impl := 'unsafe'? 'impl' generics? 'const'? ('!'? type 'for' self_type / self_type) where? '{' attr* item* '}'
type <- '(' (type (',' type)* ','?)? ')' / '!' / '&' LIFETIME? 'mut'? type1 / '&&' LIFETIME? 'mut'? type1 / '*' ('const' / 'mut') type1 / '[' type (';' expr)? ']' / '_' / forlt? ('unsafe'? ('extern' STRING?)? 'fn' '(' (attr* ((ID / '_') ':' !':')? (type / '...') (',' attr* ((ID / '_') ':' !':')? (type / '...'))* ','?)? ')' ('->' type1)?)
  / ('impl' / 'dyn') boundlist / '<' type ('as' path)? '>' ('::' segment)+ / forlt? path ('!' ('(' tree* ')' / '[' tree* ']' / '{' tree* '}'))? 
type1 = type
path <- '::'? segment ('::' segment)*
segment = ID ('::'? targs / '(' (type (',' type)* ','?)? ')' ('->' type)?)?
targs <- '<' (targ (',' targ)* ','?)? '>'
targ = LIFETIME / ID targs? '=' type / ID bounds / type / block / '-'? NUMBER / 'true' / 'false' / STRING / CHAR
block <- '{' attr* stmt* tail? '}'
tail = expr
stmt ~ ';' / attr* let / item / attr* blockexpr !('.' / '?') ';'? / attr* expr (';' / &'}' NEVER)
let = 'let' pattern (':' type)? ('=' expr ('else' block)?)? ';'
blockexpr = (LIFETIME ':')? (if / match / loop) / ('unsafe' / 'async' 'move'? / 'const')? block
if <- 'if' cond block ('else' (if / block))?
cond <- nexpr
loop = 'loop' block / 'while' cond block / 'for' pattern 'in' nexpr block
match <- 'match' nexpr '{' attr* (arm)* '}'
arm = attr* pattern ('if' expr0)? '=>' (blockexpr ','? !('.' / '?' / BINOP) / expr (',' / &'}'))
expr0 = expr
pattern <- '|'? pat ('|' pat)*
pat <- '_' / '..' / ('ref'? 'mut'? ID !('::' / '(' / '{' / '!' / '..' / '..=') ('@' pat)?) / ('&' / '&&') 'mut'? pat / '(' (pattern (',' pattern)* ','?)? ')' / '[' (pattern (',' pattern)* ','?)? ']' / rangepat / '<' type ('as' path)? '>' ('::' segment)+
  / expath ('!' ('(' tree* ')' / '[' tree* ']' / '{' tree* '}') / '{' (fieldpat (',' fieldpat)* ','?)? '}' / '(' (pattern (',' pattern)* ','?)? ')')? / 'box' pat
rangepat = (litpat / expath) (('..=' / '...') (litpat / expath) / '..' (litpat / expath)?) / ('..=' / '..') (litpat / expath) / litpat
litpat = '-'? NUMBER / STRING / CHAR / 'true' / 'false'
fieldpat = attr* ('..' / (ID / NUMBER) ':' pattern / 'ref'? 'mut'? ID)
fatom = ID ('::' ID)* / NUMBER / STRING / CHAR / 'true' / 'false'
fbin = '+' / '-' / '*' / '/' / '%' / '<<' / '&' / '|' / '^'
compare = '<' / '<=' / '>=' / '==' / '!=' / '>'
f0 = fatom ('.' ID)*
c0 = f0 (fbin f0)* (compare f0 (fbin f0)*)?
e0 = c0 (('&&' / '||') c0)*
f1 = fatom ('.' ID / '(' (e0 (',' e0)*)? ')' / '[' e0 ']')*
c1 = f1 (fbin f1)* (compare f1 (fbin f1)*)?
flat = c1 (('&&' / '||') c1)* &(',' / ')' / ']' / ';' / '}')
expr <- flat / attr* (jump / closure / range)
jump = 'return' expr? / 'break' LIFETIME? expr? / 'continue' LIFETIME? / 'yield' expr?
closure = 'static'? 'async'? 'move'? ('||' / '|' (pattern1 (':' type)? (',' pattern1 (':' type)?)* ','?)? '|') ('->' type block / expr)
pattern1 = attr* pat
range = '..=' binary / '..' binary? / binary (asgop expr / '..=' binary / '..' binary?)?
asgop = '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>='
binary <- compared (('&&' / '||') (jump / closure / compared))*
compared = bits (compare (jump / closure / bits))? !compare
bits <- unary (binop (jump / closure / unary) / 'as' type)*
binop = '+' / '-' / '*' / '/' / '%' / '<<' / '>' '>' / '&' / '|' / '^'
unary <- ('-' / '!' / '*' / ('&' / '&&') ('raw' ('const' / 'mut'))? 'mut'?) unary / 'let' pattern '=' unary / primary
primary <- atom suffix*
suffix = '.' ('await' / ID ('::' targs)? / NUMBER) / '(' (expr (',' expr)* ','?)? ')' / '[' expr ']' / '?'
atom <- blockexpr / NUMBER / STRING+ / CHAR / 'true' / 'false' / '(' (expr (',' expr)* ','?)? ')' / '[' ((NUMBER / STRING / CHAR) ',')* (expr (';' expr / (',' expr)* ','?))? ']' / '<' type ('as' path)? '>' ('::' esegment)+ / expath '!' ('(' tree* ')' / '[' tree* ']' / '{' tree* '}') / expath structbody? / closure / jump
expath <- '::'? esegment ('::' esegment)*
esegment = ID ('::' targs)?
structbody <- '{' (attr* (ID / NUMBER) (':' expr)? (',' attr* (ID / NUMBER) (':' expr)?)* (',' ('..' expr?)?)? / '..' expr?)? '}'
nexpr <- attr* (jump / closure / nrange)
nrange = '..=' nbinary / '..' nbinary? / nbinary (asgop nexpr / '..=' nbinary / '..' nbinary?)?
nbinary <- ncompared (('&&' / '||') ncompared)*
ncompared = nbits (compare nbits)? !compare
nbits <- nunary (binop nunary / 'as' type)*
nunary <- ('-' / '!' / '*' / ('&' / '&&') 'mut'?) nunary / 'let' pattern '=' nunary / nprimary
nprimary <- natom suffix*
natom <- blockexpr / NUMBER / STRING+ / CHAR / 'true' / 'false' / '(' (expr (',' expr)* ','?)? ')' / '[' ((NUMBER / STRING / CHAR) ',')* (expr (';' expr / (',' expr)* ','?))? ']' / '<' type ('as' path)? '>' ('::' esegment)+ / expath '!' ('(' tree* ')' / '[' tree* ']' / '{' tree* '}') / expath / closure / jump
"""


def _without(words: list[str], *out: str) -> list[str]:
    return [w for w in words if w not in out]


#: Words that are names unless the grammar wants them.
SOFT_SCRIPT = "async let static get set of from as type interface namespace module declare abstract readonly public private protected is keyof infer unique asserts satisfies override accessor global require constructor target meta any out implements".split()
SOFT_JAVA = "var yield record sealed permits non module open opens exports requires uses provides to with transitive when _".split()
PRIMITIVES = "boolean byte short int long char float double".split()


def _fill(text: str, parts: dict[str, str]) -> str:
    for _ in range(3):
        for k, v in parts.items():
            text = text.replace(f"@{k}@", v)
    return text


def _script(module: bool, types: bool) -> Grammar:
    parts = {**(TS if types else JS), "ASYNC": "('async' !^)?", "CAST": "", "IMPORTS": IMPORTS if module else "", "DELETE": "!('delete' ID !('.' / '?.' / '[' / '(' / '!' / TEMPLATE / HEAD))" if module else ""}
    if types:
        parts["CAST"] = "/ '<' type '>'"
    text = _fill(SCRIPT + (IMPORT_RULES if module else "") + (TYPES if types else ""), parts)
    text = text.replace("item =  stmt", "item = stmt").replace("/  stmt", "/ stmt")
    classes = {"ID": ["NAME", *SOFT_SCRIPT], "IDN": ["NAME", *lx.SCRIPT_WORDS], "MODWORD": ["public", "private", "protected", "static", "readonly", "abstract", "override", "declare", "async"] if types else ["static"]}
    return Grammar(text, classes)


@cache
def grammar(ext: str) -> Grammar:
    """The grammar of an extension."""
    language = lx.LANGUAGE_OF[ext]
    if language == "python":
        return Grammar(PYTHON, {"ID": ["NAME", "match", "case", "type", "_"], "NEVER": []}, terminator="NEWLINE")
    if language in ("javascript", "typescript"):
        return _script(ext != "cjs", language == "typescript")
    if language == "java":
        castable = ["NAME", "NUMBER", "STRING", "CHAR", "(", "this", "super", "new", "true", "false", "null", "switch", *SOFT_JAVA, *PRIMITIVES, "void"]
        return Grammar(JAVA, {"ID": ["NAME", *SOFT_JAVA], "PRIMITIVE": PRIMITIVES, "CASTABLE": castable, "NEVER": [], "MODWORD": "public private protected static final abstract strictfp".split()})
    if language == "go":
        return Grammar(GO, {"ID": ["NAME"]})
    ids = ["NAME", "crate", "self", "Self", "super", "union", "macro_rules", "auto", "default", "raw", "box"]
    leaf = [*(w for w in lx.RUST_WORDS), *(o for o in lx.RUST_OPS if o not in "()[]{}"), "NAME", "NUMBER", "STRING", "CHAR", "LIFETIME"]
    ops = "+ - * / % << > < <= >= == != & | ^ && || as = += -= *= /= ..".split()
    return Grammar(RUST, {"ID": ids, "LEAF": leaf, "BINOP": ops, "NEVER": []})

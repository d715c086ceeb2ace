"""Local grammars of typescript, javascript, c_sharp and python: what may stand between one pair of brackets, with everything bracketed inside it already reduced to a name.

A group of brackets is read once, from the inside out. Its content, a short string of token codes, is matched against the roles that such brackets can play (arguments,
parameters, block, object, class body, ...), and the group is replaced by its kind and the letters of the roles it fits. Most
contents repeat, so the answers are kept. Rules are regular expressions over token codes with recursion.

Notation of rules: 'word' a token, P.E, B.B, S.A a round, curly or square group in a role, upper case a class of tokens, lower case another rule; else as in regular expressions.
"""

from __future__ import annotations

import sys
from re import _parser as sre  # its trees of regular expressions

import regex

from codeloom.parse.lexer import CONTEXTUAL, HOLE, ID, MARK, WORDS

#: Roles by kind of bracket. A group is written as the opening of its kind, the letters of the roles it fits, and END.
ROLES = {
    "ts": {"P": "EXPFT", "B": "BOKISWN", "S": "AXY", "H": "H"},
    "js": {"P": "EXPF", "B": "BOKSW", "S": "AX", "H": "H"},
    "cs": {"P": "EXPFTGUCQ", "B": "BOKWNVYDQ", "S": "AXRZQP", "H": "H"},
    "py": {"P": "EXPSUVWICQ", "B": "OQ", "S": "AXTSVQ", "H": "H"},
}
BASE = {"P": "\ue000", "B": "\ue001", "S": "\ue002", "H": "\ue004"}
END = "\ue003"
OPEN = {"(": "P", "{": "B", "[": "S", HOLE: "H"}
CLOSE = {"(": ")", "{": "}", "[": "]", HOLE: "}"}
# Roles whose content never holds a semicolon at its own level.
NO_SEMICOLON = {"P": "EXPTGUCQSVWI", "B": "ONYQS", "S": "AXRZQPYTSV", "H": "H"}
#: Answers kept in a worker; they start anew beyond this.
CACHE = 200_000
#: Seconds for one match by backtracking; what takes longer goes to Exact. No rule holds a possessive or atomic part, so both search all ways to match, and the answer doesn't depend on time.
PATIENCE = 2.0

# The grammar of ECMAScript modules; what stands in braces {{ }} is typescript's.
JS = {
    "id": "ID", "nm": "NAME | '#'", "lit": "'n' | 'S' | 'r'", "tpl": "'T' | '`' H.H+ '`'",
    # types
    "type": "tunion ( 'extends' tunion '?' type ':' type )?",
    "tunion": "[&|]? tpost ( [&|] tpost )*",
    "tpost": "( 'keyof' | 'readonly' | 'unique' | 'infer' )* tprim ( S.Y | S.X )*",
    "tprim": "( 'abstract'? 'new' )? tparams? P.P 'A' rtype | P.T | B.I | S.Y | 'typeof' id ( '.' NAME )* targs? | 'import' P.E ( '.' NAME )* targs? | 'S' | 'n' | tpl | '+' 'n' | NAME ( '.' NAME )* targs?",
    "rtype": "( ID | 'this' ) 'is' type | 'asserts' ( ID | 'this' ) ( 'is' type )? | type",
    "targs": "'<' type ( ',' type )* ','? '>'",
    "tparams": "'<' tparam ( ',' tparam )* ','? '>'",
    "tparam": "( 'const' | 'in' | 'out' )* id ( 'extends' type )? ( '=' type )?",
    "ann": "':' rtype",
    # expressions
    "expr": "arrow | 'yield' '*'? expr? | bin ( ( '=' | 'a' ) expr | '?' expr ':' expr )?",
    "arrow": "'async'? ( id | {{tparams?}} P.P {{ann?}} ) 'A' ( B.B | expr )",
    "bin": "unary ( binop unary )*",
    "binop": "'b' | '+' | '*' | '<' | '>'{1,3} | '&' | '|' | 'in' | 'instanceof'",
    "unary": "( '+' | '!' | '~' | 'typeof' | 'void' | 'delete' | 'await' | 'I' | 'new' (?! '.' ) )* post",
    "post": "prim tail* 'I'? {{( ( 'as' | 'satisfies' ) ( 'const' | type ) )*}}",
    "tail": "'.' nm | 'q' ( nm | P.E | S.X ) | S.X | {{targs?}} P.E | tpl {{| '!'}}",
    "prim": "func | klass | ( 'import' ( P.E | '.' NAME ) | 'new' '.' NAME ) | id {{( targs (?= P.E ) )?}} | 'this' | 'super' | 'null' | 'true' | 'false' | lit | tpl | S.A | P.X | B.O | '#'",
    "list": "expr ( ',' expr )*",
    "func": "'async'? 'function' '*'? id? {{tparams?}} P.P {{ann?}} B.B",
    "fdecl": "'async'? 'function' '*'? id {{tparams?}} P.P {{ann?}} B.B",
    "klass": "deco* {{'abstract'?}} 'class' ( (?! 'extends' | 'implements' ) id )? kbody",
    "kdecl": "deco* {{'abstract'?}} 'class' id kbody",
    "kbody": "{{tparams?}} ( 'extends' post {{targs?}} )? {{( 'implements' type ( ',' type )* )?}} B.K",
    "deco": "'@' ( id ( '.' NAME )* P.E? | P.X ) 'N'?",
    # statements
    "end": "';' | 'N' | \\Z",
    "bind": "( id | B.O | S.A ) {{'!'?}} {{( ':' type )?}} ( '=' expr )?",
    "vars": "( 'var' | 'let' | 'const' {{(?! 'enum' )}} ) bind ( ',' bind )* {{| 'using' id '=' expr ( ',' id '=' expr )*}}",
    "stmts": "( ';' | 'N' | stmt )*",
    "sub": "'N'? stmt",
    "stmt": "B.B | 'if' P.X sub ( 'N'? 'else' sub )? | 'for' 'await'? P.F sub | 'while' P.X sub | 'with' P.X sub | 'do' sub 'N'? 'while' P.X ';'? | 'switch' P.X B.W | 'try' B.B ( 'catch' ( P.P )? B.B ( 'finally' B.B )? | 'finally' B.B )"
    " | 'return' list? end | 'throw' list end | 'break' id? end | 'continue' id? end | 'debugger' end | import | export | {{tdecl |}} fdecl | kdecl | vars end | id ':' sub | ';' | (?! 'function' | 'class' | 'let' S.X ) list end",
    "import": "'import' ( 'S' | {{'type'?}} ( id | ( id ',' )? ( '*' 'as' id | B.S ) ) 'from' 'S' ) ( 'with' B.O )? end {{| 'import' id '=' list end}}",
    "export": "deco* 'export' ( 'default' ( func | klass | {{tdecl |}} (?! 'function' | 'class' ) expr end ) | '*' ( 'as' ( NAME | 'S' ) )? 'from' 'S' end | {{'type'?}} B.S ( 'from' 'S' )? end | fdecl | kdecl | vars end {{| tdecl | '=' expr end | 'import' id '=' list end}} )",
    "tdecl": "'declare'? ( 'interface' id tparams? ( 'extends' type ( ',' type )* )? B.I | 'type' id tparams? '=' type end | 'const'? 'enum' id B.N | ( 'namespace' | 'module' ) ( id ( '.' NAME )* | 'S' ) B.B | 'async'? 'function' '*'? id tparams? P.P ann? end )"
    " | 'declare' ( vars end | kdecl | fdecl | 'global' B.B | 'module' 'S' end )",
    # contents of groups
    "P_E": "( 'd'? expr ( ',' 'd'? expr )* ','? )?",
    "P_X": "list",
    "P_P": "( param ( ',' param )* ','? )?",
    "param": "deco* {{( 'public' | 'private' | 'protected' | 'readonly' | 'override' )*}} 'd'? ( id | {{'this' |}} B.O | S.A ) {{'?'? ( ':' type )?}} ( '=' expr )?",
    "P_F": "( vars | list )? ';' list? ';' list? | ( 'var' | 'const' | 'let' | 'using' )? ( id | B.O | S.A | post ) ( 'of' expr | 'in' list )",
    "P_T": "{{type}}",
    "B_B": "stmts",
    "B_O": "( prop ( ',' prop )* ','? )?",
    "prop": "'d' expr | ( 'get' | 'set' ) pname P.P {{ann?}} B.B | 'async'? '*'? pname {{tparams?}} P.P {{ann?}} B.B | pname ':' expr | id ( '=' expr )?",
    "pname": "NAME | 'S' | 'n' | S.X",
    "B_K": "( ';' | 'N' | member )*",
    "cname": "pname | '#'",
    "member": "deco* mod*? ( 'static' B.B | 'async'? '*'? cname {{'?'? tparams?}} P.P {{ann?}} ( B.B {{| end}} ) | ( 'get' | 'set' ) cname P.P {{ann?}} ( B.B {{| end}} ) | cname {{( '?' | '!' )? ( ':' type )?}} ( '=' expr )? end {{| S.Y ':' type end}} )",
    "mod": "'static' {{| 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare' | 'accessor'}}",
    "B_I": "{{( ';' | ',' | 'N' )* ( imember ( ( ';' | ',' | 'N' )+ | \\Z ) )*}}",
    "imember": "'readonly'? pname '?'? ( ':' type )? | ( ( 'get' | 'set' )? pname )? '?'? tparams? P.P ann? | 'new' tparams? P.P ann? | ( '+' | 'readonly' )* S.Y '+'? '?'? ':' type",
    "B_S": "( {{'type'?}} ( NAME | 'S' ) ( 'as' ( NAME | 'S' ) )? ( ',' {{'type'?}} ( NAME | 'S' ) ( 'as' ( NAME | 'S' ) )? )* ','? )?",
    "B_W": "( ( 'case' list | 'default' ) ':' stmts )*",
    "B_N": "{{( pname ( '=' expr )? ( ',' pname ( '=' expr )? )* ','? )?}}",
    "H_H": "list",
    "elem": "'d'? expr", "eitem": "pname ( '=' expr )?",
    "S_A": "( ',' | 'd'? expr ( ',' | \\Z ) )*",
    "S_X": "list",
    "S_Y": "{{( telem ( ',' telem )* ','? )? | id ':' type | id 'in' type ( 'as' type )?}}",
    "telem": "( NAME '?'? ':' )? 'd'? ( NAME '?'? ':' )? type '?'?",
    "unit": "stmts",
}

# The grammar of c_sharp.
CS = {
    "id": "ID", "lit": "'n' | 'S' | '`' ( H.H )* '`' | 'true' | 'false' | 'null'",
    "predef": "'bool' | 'byte' | 'char' | 'decimal' | 'double' | 'float' | 'int' | 'long' | 'object' | 'sbyte' | 'short' | 'string' | 'uint' | 'ulong' | 'ushort' | 'void'",
    "qname": "id targs? ( '.' id targs? )*",
    "targs": "'<' type? ( ',' type? )* '>'",
    "type": "'scoped'? ( 'ref' 'readonly'? )? ( predef | qname | P.U ) ( '?' | '*' | S.R )*",
    "expr": "lambda | query | ( 'throw' | 'ref' ) expr | bin ( ( '=' | 'a' | '>'{2,3} '=' | '>'{1,2} 'b' ) expr | '?' expr ':' expr )?",
    "lambda": "attr* ( 'static' | 'async' )* ( id | type? P.P | P.P ) 'A' ( B.B | expr ) | 'async'? 'delegate' P.P? B.B",
    "bin": "unary ( binop unary | 'is' pattern | 'as' type | 'switch' B.Y | 'with' B.O )*",
    "binop": "'b' | '+' | '*' | '<' | '>'{1,3} | '>' 'b' | '&' | '|' | 'd'",
    "unary": "( '+' | '!' | '~' | '*' | '&' | 'I' | 'b' | 'd' | 'await' | P.T (?= ID | 'n' | 'S' | '`' | PREDEF | VALUE | '!' | '~' | GROUP | 'await' ) )* ( post | 'd' )",
    "post": "prim tail*",
    "tail": "'.' id ( targs (?! ID | 'n' | 'S' ) )? | '?' '.' id targs? | P.E | S.X | '?' S.X | 'I' | '!'",
    "prim": "'new' ( S.X | S.R )* ( type ( S.X S.R* )? )? P.E? ( B.O )? | 'typeof' P.T | 'sizeof' P.T | 'default' P.T? | ( 'checked' | 'unchecked' ) P.X | 'stackalloc' type? S.X? B.O? | lit | 'this' | 'base' | id ( targs (?! ID | 'n' | 'S' ) )? | PREDEF | P.X | P.E | S.A",
    "query": "'from' type? id 'in' expr ( 'from' type? id 'in' expr | 'let' id '=' expr | 'where' expr | 'join' type? id 'in' expr 'on' expr 'equals' expr ( 'into' id )? | 'orderby' expr ( 'ascending' | 'descending' )? ( ',' expr ( 'ascending' | 'descending' )? )* | 'select' expr ( 'into' id )? | 'group' expr 'by' expr ( 'into' id )? )+",
    "pattern": "patom ( ( 'and' | 'or' ) patom )*",
    "patom": "'not'* ( 'var' ( id | P.E ) | ( '<' | '>' | 'b' ) unary | P.Q | ( type )? ( P.Q )? B.Q id? | type P.Q id? | type id | S.Q id? | unary )",
    "init": "'ref'? expr | B.O",
    "decl": "( 'await'? 'using' )? ( 'const' | 'static' )* type id ( '=' init )? ( ',' id ( '=' init )? )*",
    "stmts": "stmt*",
    "stmt": "';' | B.B | 'if' P.X stmt ( 'else' stmt )? | 'while' P.X stmt | 'for' P.F stmt | 'await'? 'foreach' P.G stmt | 'do' stmt 'while' P.X ';' | 'switch' ( P.X | P.E ) B.W | 'try' B.B ( ( 'catch' P.C? ( 'when' P.X )? B.B )+ ( 'finally' B.B )? | 'finally' B.B )"
    " | 'lock' P.X stmt | 'await'? 'using' ( P.G | P.X ) stmt | 'fixed' P.G stmt | ( 'checked' | 'unchecked' | 'unsafe' ) B.B | 'return' 'ref'? expr? ';' | 'throw' expr? ';' | ( 'break' | 'continue' ) ';' | 'goto' ( id | 'case' expr | 'default' ) ';' | 'yield' ( 'return' expr | 'break' ) ';'"
    " | decl ';' | attr* fmod* type id tparams? P.P where* ( B.B | 'A' expr ';' ) | id ':' stmt | effect ';'",
    "effect": "(?= [^;]*? ( '=' | 'a' | 'I' ) | 'await' | 'new' | [^;]* PE '!'* ';' ) expr",
    "fmod": "'static' | 'async' | 'unsafe' | 'extern'",
    "tparams": "'<' attr* ( 'in' | 'out' )? id ( ',' attr* ( 'in' | 'out' )? id )* '>'",
    "where": "'where' id ':' ( 'class' '?'? | 'struct' | 'new' P.E | 'default' | type ) ( ',' ( 'class' '?'? | 'struct' | 'new' P.E | type ) )*",
    "attr": "S.Z",
    "mod": "'public' | 'private' | 'protected' | 'internal' | 'static' | 'abstract' | 'sealed' | 'virtual' | 'override' | 'readonly' | 'extern' | 'new' | 'partial' | 'async' | 'unsafe' | 'volatile' | 'const' | 'required' | 'file' | 'ref' | 'fixed'",
    "body": "B.B | 'A' expr ';'",
    "member": "attr* mod*? ( tdecl | type ( qname '.' )? id tparams? P.P where* ( body | ';' ) | id P.P ( ':' ( 'base' | 'this' ) P.E )? ( body | ';' ) | '~' id P.P body | type ( qname '.' )? id ( B.V ( '=' init ';' )? | 'A' expr ';' ) | type ( qname '.' )? 'this' S.P ( B.V | 'A' expr ';' )"
    " | 'event' type qname ( B.V | ( ',' id )* ( '=' expr )? ';' ) | type id ( S.X )? ( '=' init )? ( ',' id ( '=' init )? )* ';' | ( 'implicit' | 'explicit' ) 'operator' 'checked'? type P.P ( body | ';' ) | type 'operator' 'checked'? ( [+!~*&|Ib<] | 'b' | '>'+ | 'true' | 'false' ) P.P ( body | ';' ) )",
    "tdecl": "( 'class' | 'struct' | 'interface' | 'record' ( 'class' | 'struct' )? ) id tparams? P.P? ( ':' type P.E? ( ',' type )* )? where* ( B.K ';'? | ';' ) | 'enum' id ( ':' type )? B.N ';'? | 'delegate' type id tparams? P.P where* ';'",
    "using": "'global'? 'using' ( 'static' | 'unsafe' )* ( id '=' )? type ';' | 'extern' 'alias' id ';'",
    "space": "'namespace' qname ( ';' | B.D ';'? )",
    "P_E": "( arg ( ',' arg )* )?",
    "arg": "( id ':' )? ( 'out' ( type id | expr ) | ( 'ref' | 'in' ) expr | 'var'? type id | expr )",
    "P_X": "expr",
    "P_P": "( param ( ',' param )* )?",
    "param": "attr* ( 'this' | 'ref' 'readonly'? | 'out' | 'in' | 'params' | 'scoped' )* type id ( '=' expr )? | ( 'ref' | 'out' | 'in' )* id",
    "P_F": "( decl | expr ( ',' expr )* )? ';' expr? ';' ( expr ( ',' expr )* )?",
    "P_T": "type",
    "P_G": "( type id | 'var' P.E | P.E ) 'in' expr | decl",
    "P_U": "type id? ( ',' type id? )+",
    "P_C": "type id?",
    "P_Q": "pattern | ( ( id ':' )? pattern ( ',' ( id ':' )? pattern )* )?",
    "B_B": "stmts",
    "B_O": "( oelem ( ',' oelem )* ','? )?",
    "oelem": "( id | S.X ) '=' init | B.O | expr",
    "B_K": "member*",
    "B_W": "( ( 'case' pattern ( 'when' expr )? ':' | 'default' ':' )+ stmt+ )*",
    "B_N": "( attr* id ( '=' expr )? ( ',' attr* id ( '=' expr )? )* ','? )?",
    "H_H": "expr ( ',' '+'? 'n' )?",
    "B_V": "( attr* mod* ( 'get' | 'set' | 'init' | 'add' | 'remove' ) ( ';' | body ) )+",
    "B_Y": "( pattern ( 'when' expr )? 'A' expr ( ',' pattern ( 'when' expr )? 'A' expr )* ','? )?",
    "B_D": "( using | space | attr* mod* tdecl )*",
    "B_Q": "( id ( '.' id )* ':' pattern ( ',' id ( '.' id )* ':' pattern )* ','? )?",
    "elem": "'d'? expr", "eitem": "attr* id ( '=' expr )?",
    "S_A": "( ( 'd' )? expr ( ',' 'd'? expr )* ','? )?",
    "S_X": "arg ( ',' arg )*",
    "S_R": "','*",
    "S_Z": "( id ':' | 'return' ':' | 'event' ':' )? qname P.E? ( ',' qname P.E? )* ','?",
    "S_P": "param ( ',' param )*",
    "S_Q": "( ( 'd' pattern? | pattern ) ( ',' ( 'd' pattern? | pattern ) )* )?",
    "unit": "using* attr* ( using | space | attr* mod* tdecl | stmt )*",
}


# The grammar of python. A line is one logical line: simple statements, or the head of a compound one, perhaps with its body.
PY = {
    "id": "ID", "fstr": "'`' H.H* '`'", "lit": "'n' | ( 'S' | fstr )+ | 'y'+ | 'None'",
    # expressions
    "atom": "ID | lit | 'd' | P.X | S.A | B.O",
    "trailer": "'.' ID | P.E | S.X",
    "primary": "atom trailer*",
    "unary": "( '+' | '~' )* 'await'? primary",
    "bor": "unary ( ( '|' | 'b' | '/' | '+' | '*' | '@' | 'X' ) unary )*",
    "comp": "bor ( ( 'c' | 'in' | 'not' 'in' | 'is' 'not'? ) bor )*",
    "inv": "'not'* comp",
    "disj": "inv ( ( 'and' | 'or' ) inv )*",
    "expr": "disj ( 'if' disj 'else' expr )? | 'lambda' lparams ':' expr",
    "named": "ID 'w' expr | expr",
    "star": "'*' bor | named",
    "stars": "( '*' bor | expr ) ( ',' ( '*' bor | expr ) )* ','?",
    "yield": "'yield' ( 'from' expr | stars )?",
    "cfor": "( 'async'? 'for' targets 'in' disj ( 'if' disj )* )+",
    # targets
    "place": "primary ( '.' ID | S.X )",
    "target": "ID | place | P.S | S.S", "starget": "'*'? target",
    "targets": "starget ( ',' starget )* ','?",
    "single": "ID | place | P.U",
    "dtargets": "dtarget ( ',' dtarget )* ','?",
    "dtarget": "ID | place | P.V | S.V",
    # simple statements
    "rhs": "yield | stars",
    "dotted": "ID ( '.' ID )*",
    "names": "ID ( 'as' ID )? ( ',' ID ( 'as' ID )? )*",
    "simple": "( targets '=' )* rhs | single ':' expr ( '=' rhs )? | single 'a' rhs | 'return' stars? | 'raise' ( expr ( 'from' expr )? )? | 'pass' | 'break' | 'continue' | 'del' dtargets | ( 'global' | 'nonlocal' ) ID ( ',' ID )*"
    " | 'assert' expr ( ',' expr )? | 'import' dotted ( 'as' ID )? ( ',' dotted ( 'as' ID )? )* | 'from' ( ( '.' | 'd' )* dotted | ( '.' | 'd' )+ ) 'import' ( '*' | names | P.I ) | 'type' ID S.T? '=' expr",
    "simples": "simple ( ';' simple )* ';'?",
    # parameters
    "N": "ID ( ':' expr )?", "D": "ID ( ':' expr )? '=' expr",
    "positional": "N ( ',' ( N | '/' ) )* ( ',' ( D | '/' ) )* | D ( ',' ( D | '/' ) )*",
    "kw": "'X' ID ( ':' expr )?",
    "only": "'*' ( ID ( ':' ( '*' bor | expr ) )? ( ',' ( N | D ) )* | ( ',' ( N | D ) )+ ) ( ',' kw )?",
    "lname": "ID", "ldef": "ID '=' expr",
    "lpositional": "lname ( ',' ( lname | '/' ) )* ( ',' ( ldef | '/' ) )* | ldef ( ',' ( ldef | '/' ) )*",
    "lonly": "'*' ( ID ( ',' ( lname | ldef ) )* | ( ',' ( lname | ldef ) )+ ) ( ',' 'X' ID )?",
    "lparams": "( ( lpositional ( ',' ( lonly | 'X' ID ) )? | lonly | 'X' ID ) ','? )?",
    # patterns
    "plit": "'+'? 'n' ( '+' 'n' )? | ( 'S' | fstr )+ | 'y'+ | 'None'",
    "pattern": "spattern ( ',' spattern )* ','?",
    "spattern": "'*' ID | aspattern",
    "aspattern": "orpattern ( 'as' ID )?",
    "orpattern": "cpattern ( '|' cpattern )*",
    "cpattern": "plit | ID ( '.' ID )* P.C? | P.Q | S.Q | B.Q",
    # heads of compound statements
    "body": "simples?",
    "witem": "expr ( 'as' '*'? target )?",
    "line": "simples",
    "if": "'if' named ':' body", "elif": "'elif' named ':' body", "else": "'else' ':' body", "while": "'while' named ':' body", "for": "'async'? 'for' targets 'in' stars ':' body",
    "try": "'try' ':' body", "except": "'except' ( expr ( 'as' ID )? )? ':' body", "exceptstar": "'except' '*' expr ( 'as' ID )? ':' body", "finally": "'finally' ':' body",
    "with": "'async'? 'with' ( witem ( ',' witem )* | P.W ) ':' body", "def": "'async'? 'def' ID S.T? P.P ( 'A' expr )? ':' body", "class": "'class' ID S.T? P.E? ':' body",
    "match": "'match' ( star ',' ( star ( ',' star )* ','? )? | named ) ':'", "case": "'case' pattern ( 'if' named )? ':' body", "decorator": "'@' named",
    # contents of groups
    "pos": "'*' expr | named", "kwst": "ID '=' expr | '*' expr", "kwds": "ID '=' expr | 'X' expr",
    "kws": "kwst ( ',' kwst )* ( ',' kwds ( ',' kwds )* )? | kwds ( ',' kwds )*",
    "P_E": "( named cfor | pos ( ',' pos )* ( ',' kws )? ','? | kws ','? )?",
    "P_X": "( yield | named cfor | named | star ',' ( star ( ',' star )* ','? )? )?",
    "P_P": "( ( positional ( ',' ( only | kw ) )? | only | kw ) ','? )?",
    "P_S": "targets?", "P_U": "single", "P_V": "dtargets?",
    "P_W": "witem ( ',' witem )* ','?",
    "P_I": "names ','?",
    "citem": "( ID '=' )? aspattern",
    "P_C": "( citem ( ',' citem )* ','? )?",
    "P_Q": "pattern?",
    "S_A": "( named cfor | star ( ',' star )* ','? )?",
    "S_X": "slice ( ',' slice )* ','?",
    "slice": "expr? ':' expr? ( ':' expr? )? | named | '*' bor",
    "S_T": "tparam ( ',' tparam )* ','?",
    "tparam": "ID ( ':' expr )? ( '=' expr )? | '*' ID ( '=' ( '*' bor | expr ) )? | 'X' ID ( '=' expr )?",
    "S_S": "targets?", "S_V": "dtargets?", "S_Q": "pattern?",
    "B_O": "( item ( ',' item )* ','? | expr ':' expr cfor | named cfor | star ( ',' star )* ','? )?",
    "item": "'X' bor | expr ':' expr",
    "B_Q": "( ( ( plit | ID ( '.' ID )+ ) ':' aspattern | 'X' ID ) ( ',' ( ( plit | ID ( '.' ID )+ ) ':' aspattern | 'X' ID ) )* ','? )?",
    "H_H": "( yield | stars ) '='? '!'? ( ':' H.H* )?",
    "unit": "simples",
}
#: The rule of one item of a role that is a list with commas. A long list fits its role if all its items fit this; else the role's own rule decides.
ITEMS = {
    "js": {"P_E": "elem", "P_X": "expr", "B_O": "prop", "S_A": "elem", "S_X": "expr", "S_Y": "telem", "B_N": "eitem"},
    "cs": {"P_E": "arg", "B_O": "oelem", "S_A": "elem", "S_X": "arg", "B_N": "eitem"},
    "py": {"P_E": "pos", "P_X": "star", "S_A": "star", "S_X": "slice", "P_S": "starget", "S_S": "starget", "P_V": "dtarget", "S_V": "dtarget", "P_W": "witem", "P_Q": "spattern", "S_Q": "spattern", "P_C": "citem", "B_O": "item"},
}
ITEMS["ts"] = ITEMS["js"]
#: Roles whose lists may not end with a comma.
UNENDED = {"js": ("P_X", "S_X"), "cs": ("P_E", "S_X"), "py": ()}
UNENDED["ts"] = UNENDED["js"]
#: Kinds of logical lines of python besides simple statements, in the order in which they are tried.
#: Those that begin with a word; all others are simple statements. A soft keyword may be a name.
BY_WORD = {"if": "if", "elif": "elif", "else": "else", "while": "while", "for": "for", "async": "for with def", "try": "try", "except": "exceptstar except", "finally": "finally", "with": "with", "def": "def", "class": "class", "match": "match", "case": "case", "@": "decorator"}
HEADS = "if elif else while for try exceptstar except finally with def class match case decorator".split()


def _group(kind: str, role: str) -> str:
    return f"(?:{BASE[kind]}[A-Z]*{role}[A-Z]*{END})"


class Exact:
    """The rules read without backtracking: the set of ends of each part at each place is found once, so time is polynomial in the content. Answers are those of a search through all ways to match."""

    def __init__(self, bodies: dict[str, str]):
        self.bodies = bodies
        self.named = {chr(0xF0000 + k): name for k, name in enumerate(bodies)}
        self.calls = {name: c for c, name in self.named.items()}
        self.trees: dict[str, list] = {}

    def tree(self, name: str) -> list:
        if name not in self.trees:
            self.trees[name] = list(sre.parse(regex.sub(r"\(\?&(\w+)\)", lambda m: self.calls[m[1]], self.bodies[name])))
        return self.trees[name]

    def fits(self, name: str, content: str) -> bool:
        """Whether a rule matches the whole content."""
        before = sys.getrecursionlimit()
        sys.setrecursionlimit(max(before, 100_000 + 200 * len(content)))  # frames of Python functions alone
        try:
            return len(content) in self._sequence(self.tree(name), {0}, content, {})
        finally:
            sys.setrecursionlimit(before)

    def _sequence(self, nodes, starts: set[int], content: str, memo: dict) -> set[int]:
        for node in nodes:
            ends: set[int] = set()
            for at in starts:
                ends |= self._ends(node, at, content, memo)
            if not ends:
                return ends
            starts = ends
        return starts

    def _ends(self, node, at: int, content: str, memo: dict) -> set[int]:
        op, arg = node
        c = content[at : at + 1]
        if op is sre.LITERAL:
            if (name := self.named.get(chr(arg))) is None:
                return {at + 1} if c and ord(c) == arg else set()
            key = (name, at)
            if key not in memo:
                memo[key] = self._sequence(self.tree(name), {at}, content, memo)
            return memo[key]
        if op is sre.NOT_LITERAL:
            return {at + 1} if c and ord(c) != arg else set()
        if op is sre.IN:
            out = {at + 1} if c and _in_class(arg, ord(c)) else set()
            for kind, x in arg:  # alternatives of one rule each are parsed as a class
                if kind is sre.LITERAL and chr(x) in self.named:
                    out |= self._ends((kind, x), at, content, memo)
            return out
        if op is sre.AT:  # the end
            return {at} if at == len(content) else set()
        key = (id(node), at)
        if key in memo:
            return memo[key]
        if op is sre.SUBPATTERN:
            out = self._sequence(arg[3], {at}, content, memo)
        elif op is sre.BRANCH:
            out = set()
            for way in arg[1]:
                out |= self._sequence(way, {at}, content, memo)
        elif op is sre.ASSERT or op is sre.ASSERT_NOT:
            if arg[0] < 0:
                raise ValueError("rules do not look back")
            out = {at} if bool(self._sequence(arg[1], {at}, content, memo)) == (op is sre.ASSERT) else set()
        elif op is sre.MAX_REPEAT or op is sre.MIN_REPEAT:
            least, most, part = arg
            now, out, n = {at}, set(), 0
            while now and n < least:
                now, n = self._sequence(part, now, content, memo), n + 1
            out |= now
            while now and n < most:
                now, n = self._sequence(part, now, content, memo) - out, n + 1
                out |= now
        else:
            raise ValueError(f"no rule holds {op}")
        memo[key] = out
        return out


def _in_class(items: list, c: int) -> bool:
    hit = False
    for op, arg in items:
        if op is sre.LITERAL and arg == c or op is sre.RANGE and arg[0] <= c <= arg[1]:
            hit = True
    return hit != (items[0][0] is sre.NEGATE)


class Grammar:
    def __init__(self, lang: str):
        rules = {"ts": JS, "js": JS, "cs": CS, "py": PY}[lang]
        words, own = WORDS[lang], ROLES[lang]
        classes = {
            "ID": "[" + ID + "".join(CONTEXTUAL[lang]) + "]", "NAME": "[" + ID + "".join(words.values()) + "]", "GROUP": "[" + "".join(BASE.values()) + "]",
            "PE": _group("P", "E"),
        }
        if lang == "cs":
            classes["PREDEF"] = "[" + "".join(words[w] for w in "bool byte char decimal double float int long object sbyte short string uint ulong ushort".split()) + "]"
            classes["VALUE"] = "[" + "".join(words[w] for w in "this base null true false new typeof default sizeof".split()) + "]"
        token = regex.compile(r"'([^']+)'|\b([PBSH])\.([A-Z])\b|\{\{|\}\}|(\\Z|\(\?[<!=]+|\[[^\]]+\]|\{\d,?\d?\})|([A-Z]{2,})|([a-zA-Z]+(?:_[A-Z])?)|\s+|(.)")

        def translate(rule: str) -> str:
            if lang != "ts":
                rule = regex.sub(r"\{\{(?:(?!\}\}).)*\}\}", lambda m: "", rule)
            out = []
            for m in token.finditer(rule):
                quoted, kind, role, keep, klass, name, other = m.groups()
                if quoted:
                    out.append(words.get(quoted) or regex.escape(quoted))
                elif kind:
                    out.append(_group(kind, role) if role in own[kind] else "(?!)")
                elif keep:
                    out.append(keep)
                elif klass:
                    out.append(classes[klass])
                elif name:
                    out.append(f"(?&{name})")
                elif other:
                    out.append("(?:" if other == "(" else other)
            return "".join(out)

        never = r"(?!)"
        bodies = {k: translate(v) or never for k, v in rules.items()}
        self.exact = Exact(bodies)
        # one expression for all rules that are asked for, as each would hold the whole grammar: the content follows the rule's letter
        self.roles = {kind: [r for r in roles if f"{kind}_{r}" in rules and bodies[f"{kind}_{r}"] != never] for kind, roles in own.items()}
        # lists of statements and of members are matched piece by piece, as the pieces repeat more than the lists
        self.pieces = {"B_B", "B_K", "unit"} & set(bodies)
        self.items, self.unended = {r: i for r, i in ITEMS[lang].items() if bodies.get(i, never) != never}, UNENDED[lang]
        asked = [f"{kind}_{r}" for kind, roles in self.roles.items() for r in roles] + ["unit", *self.items.values()] + (["line", *HEADS] if lang == "py" else [])
        self.by_word = {words.get(w, w): [h for h in HEADS if h in heads.split()] for w, heads in BY_WORD.items()} if lang == "py" else {}
        self.letters = {name: chr(0xF100 + k) for k, name in enumerate(dict.fromkeys(asked))}
        self.rules = regex.compile("(?(DEFINE)" + "".join(f"(?P<{k}>{v})" for k, v in bodies.items()) + ")(?:" + "|".join(f"{c}(?&{name})" for name, c in self.letters.items()) + r")\Z")
        self.breaks = regex.compile(MARK + "..", regex.S) if lang == "py" else None
        # a piece ends with a semicolon, or with a curly group (and its line end) before a word that carries no expression or statement on
        after = f"(?<={BASE['B']}[A-Z]*{END})"
        onward = set() if lang == "py" else set("else catch finally while when and or is as in on of by into equals switch with select where orderby let join group from ascending descending instanceof satisfies extends implements".split())
        starts = "".join({c for w, c in words.items() if w not in onward})
        until = "".join(words[w] for w in ("else", "while", "catch", "finally") if w in words)
        line = f"|(?<={BASE['B']}[A-Z]*{END}N)(?![{until}])" if lang != "cs" else ""
        self.cuts = {} if lang == "py" else {r: regex.compile(f"(?<=;)(?![{until}])|{after}(?={follow}){line}", regex.V1) for r, follow in (("B_B", f"[{starts}]"), ("unit", f"[{starts}]"), ("B_K", f"[@#*{BASE['S']}{ID}{''.join(words.values())}]"))}
        self.only_semicolons = ("PF", "BV") if lang == "cs" else ()
        self.contextual = CONTEXTUAL[lang]
        # roles that need one of these codes in their content, and roles that only patterns play
        of = lambda names: set(words[w] for w in names.split())
        self.needs = {"PG": of("in") | {"="}, "PU": {","}, "BD": of("class struct interface enum record delegate namespace using"), "BW": of("case default"), "BY": {"A"}, "BV": of("get set init add remove"), "BQ": {":"}} if lang == "cs" else {"BW": of("case default")} if lang != "py" else {"PI": {ID} | self.contextual, "PW": of("as")}
        self.rich_roles = {"cs": {"PQ", "BQ", "SQ", "BY"}, "py": {"PC", "PQ", "SQ", "BQ"}}.get(lang, set())
        self.rich_word = {"cs": regex.compile(r"\b(?:is|case|switch)\b"), "py": regex.compile(r"\bcase\b")}.get(lang)
        # codes that no target holds outside of brackets, and those that parameters and imported names begin with
        self.bans = dict.fromkeys(("PS", "PU", "PV", "SS", "SV"), set("+b|/c~=:wa") | {c for w, c in words.items() if c not in self.contextual and w != "None"} - {words.get("None")}) if lang == "py" else {}
        self.begins = {"PP": {ID, "*", "X"} | self.contextual, "PI": {ID} | self.contextual} if lang == "py" else {}
        self.known: dict[tuple[str, str, bool], str | None] = {}
        self.fits: dict[tuple[str, str], bool] = {}

    def group(self, opening: str, content: str, rich: bool = True) -> str | None:
        """The name of a group, or None where its content fits no role. Roles in patterns are tried only where the text is rich, that is, may have patterns."""
        key = (opening, content, rich)
        if key not in self.known:
            if len(self.known) > CACHE:
                self.known.clear()
            if self.breaks:
                content = self.breaks.sub("", content)
            kind, fits = OPEN[opening], ""
            semicolons = ";" in content
            for role in self.roles[kind]:
                if semicolons and role in NO_SEMICOLON[kind] or not semicolons and (kind + role) in self.only_semicolons:
                    continue
                name = kind + role
                if name in self.rich_roles and not rich or content and name in self.needs and self.needs[name].isdisjoint(content):
                    continue
                if content and (name in self.bans and not self.bans[name].isdisjoint(content) or name in self.begins and content[0] not in self.begins[name]):
                    continue
                rule = f"{kind}_{role}"
                fits += role * (self.all_fit(rule, content) if rule in self.pieces else self.listed(rule, content))
            self.known[key] = BASE[kind] + fits + END if fits else None
        return self.known[key]

    def match(self, rule: str, content: str) -> bool:
        try:
            return bool(self.rules.match(self.letters[rule] + content, timeout=PATIENCE))
        except TimeoutError:
            return self.exact.fits(rule, content)

    def listed(self, rule: str, content: str) -> bool:
        if (item := self.items.get(rule)) and content.count(",") > 2:
            pieces = content.split(",")
            if not pieces[-1] and rule not in self.unended:
                pieces.pop()
            if all(self.fit(item, x) for x in set(pieces)):
                return True
        return self.match(rule, content)

    def fit(self, rule: str, content: str) -> bool:
        """As match, with answers kept."""
        if len(self.fits) > CACHE:
            self.fits.clear()
        if (rule, content) not in self.fits:
            self.fits[rule, content] = self.match(rule, content)
        return self.fits[rule, content]

    def all_fit(self, rule: str, content: str) -> bool:
        return all(self.fit(rule, piece) for piece in self.cuts[rule].split(content))

    def head(self, content: str) -> str | None:
        """The kind of a logical line of python: line for simple statements, or of HEADS; None where it is neither."""
        heads = self.by_word.get(content[:1], [])
        tried = heads if heads and content[0] not in self.contextual else ["line", *heads]
        return next((r for r in tried if self.fit(r, content)), None)

    def whole(self, content: str) -> bool:
        """Whether a reduced text is a whole module or compilation unit."""
        return self.python(content) if self.breaks else self.all_fit("unit", content)

    def python(self, content: str) -> bool:
        """Whether logical lines, each behind its indentation, are valid and nest as statements do."""
        before, *rows = content.split(MARK)
        if before:
            return False
        stack, kinds = [(0, 0)], [""]  # of open blocks: indentation, and the last statement's kind
        opened = None  # by the line before
        inside = ["module"]
        for row in rows:
            col, alt, line = ord(row[0]), ord(row[1]), row[2:]
            col, alt = col - 0xF0000, alt - 0xF0000
            kind = self.head(line)
            if kind is None:
                return False
            if opened:
                if col <= stack[-1][0] or alt <= stack[-1][1]:
                    return False
                stack.append((col, alt))
                kinds.append("")
                inside.append(opened)
                opened = None
            else:
                while col < stack[-1][0]:
                    if kinds[-1] in ("try", "decorator"):
                        return False
                    stack.pop()
                    kinds.pop()
                    inside.pop()
                if (col, alt) != stack[-1]:
                    return False
            last = kinds[-1]
            if (kind == "case") != (inside[-1] == "match") or last == "try" and kind not in ("except", "exceptstar", "finally") or last == "decorator" and kind not in ("decorator", "def", "class"):
                return False
            if kind in AFTER and last not in AFTER[kind]:
                return False
            kinds[-1] = "tryelse" if kind == "else" and last in ("except", "exceptstar") else kind
            if kind != "line" and kind != "decorator" and line.endswith(":"):
                opened = kind
        return not opened and not any(k in ("try", "decorator") for k in kinds)

    def rich(self, text: str) -> bool:
        """Whether a text may hold patterns."""
        return self.rich_word is None or bool(self.rich_word.search(text))

    def reduce(self, codes: str, rich: bool = True) -> str | None:
        """Codes with every balanced group replaced by its name, from the inside out; unmatched brackets stay. None where a group is invalid or closed by another bracket."""
        bad = False

        def name(m) -> str:
            nonlocal bad
            text = m[0]
            g = self.group(text[0], text[1:-1], rich) if CLOSE[text[0]] == text[-1] else None
            bad = bad or g is None
            return g or ""

        n = 1
        while n and not bad:
            codes, n = _INNERMOST.subn(name, codes)
        return None if bad else codes


#: What must stand before in the same block: of clauses that go on with a statement.
AFTER = {
    "elif": ("if", "elif"), "else": ("if", "elif", "for", "while", "except", "exceptstar"), "except": ("try", "except"), "exceptstar": ("try", "exceptstar"),
    "finally": ("try", "except", "exceptstar", "tryelse"),
}
_INNERMOST = regex.compile(r"[(\[{$][^()\[\]{}$]*[)\]}]")
_grammars: dict[str, Grammar] = {}


def grammar(lang: str) -> Grammar:
    """The grammar of a language, one a worker process."""
    short = {"typescript": "ts", "javascript": "js", "c_sharp": "cs", "python": "py"}[lang]
    if short not in _grammars:
        _grammars[short] = Grammar(short)
    return _grammars[short]

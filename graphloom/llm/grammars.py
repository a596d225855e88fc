"""Grammars of the registered languages, after brackets have been reduced to one token each.

``GROUPS`` names what a bracketed group may be: kind, opening bracket, and the symbol of its content. ``X?`` allows an empty
group; ``X;`` means statements or members, each one an X. Capital names in a grammar that are kinds of groups are terminals.
Words and operators that are not listed in ``WORDS`` are names (``id``) or stand for themselves. Languages with ``ASI`` end
statements at line ends too. The keyword, operator and type-name lists are fixed values of the languages.
"""

from __future__ import annotations

#: Keywords that are no names. Soft keywords are tokens too, and the grammars take them as names where the language does.
WORDS = {
    "c": "if else for while do return break continue switch case default struct union enum typedef static const extern inline goto sizeof unsigned signed volatile register restrict int char void long short float double asm __asm__ __attribute__ __extension__",
    "cpp": "if else for while do return break continue switch case default struct union enum typedef static const extern inline goto sizeof unsigned signed volatile register int char void long short float double bool auto class public private protected virtual override final namespace using template typename operator new delete throw try catch constexpr noexcept explicit friend mutable decltype static_assert this true false nullptr __attribute__ __extension__ alignas consteval constinit concept requires co_return co_await co_yield thread_local",
    "java": "if else for while do return break continue switch case default class interface enum extends implements new import package public private protected static final abstract throw throws try catch finally synchronized instanceof int char void long short float double boolean byte native transient volatile strictfp assert yield record",
    "csharp": "if else for while do return break continue switch case default class interface enum struct new using namespace public private protected internal static readonly const abstract virtual override sealed throw try catch finally foreach in is as out ref params this base void get set init add remove async await yield lock where var operator event delegate partial extern typeof checked unchecked unsafe implicit explicit when record goto fixed with not and or",
    "go": "if else for range return break continue switch case default func type struct interface package import var const go defer map chan select goto fallthrough",
    "javascript": "if else for while do return break continue switch case default class extends new import export from function var let const throw try catch finally async await of in typeof void delete instanceof static as get set yield debugger with enum",
    "typescript": "if else for while do return break continue switch case default class extends implements new import export from function var let const throw try catch finally async await of in typeof void delete instanceof static as get set yield debugger with enum interface type public private protected readonly abstract declare namespace module is keyof infer satisfies asserts override unique global accessor",
    "php": "if else elseif for foreach while do return break continue switch case default class interface trait enum extends implements new use namespace function fn public private protected static final abstract const var throw try catch finally echo print as instanceof insteadof global unset isset list array match readonly clone endif endfor endforeach endwhile endswitch include include_once require require_once yield and or xor goto declare",
    "rust": "if else for while loop return break continue match fn let mut const static struct enum union trait impl mod use pub crate as in where type ref move async await dyn unsafe extern self Self super",
    "scala": "if else for while do return match case class object trait extends with new import package def val var type lazy private protected override final sealed abstract implicit throw try catch finally yield this super null",
    "python": "if elif else for while def class return import from as pass break continue in not and or is lambda with try except finally raise assert del global nonlocal yield async await None True False match case type",
    "ruby": "if elsif else unless while until for in def class module end do begin rescue ensure case when then return break next redo retry require require_relative and or not yield attr_reader attr_accessor attr_writer self alias undef definedq BEGIN END",
}
WORDS = {k: frozenset(v.split()) for k, v in WORDS.items()}

#: Operators longer than a character, by language; longest first when they are cut.
OPERATORS = {
    "c": "<<= >>= ... -> ++ -- && || == != <= >= << >> += -= *= /= %= &= |= ^= ##",
    "cpp": "<<= ... ->* -> ++ -- && || == != <= >= << += -= *= /= %= &= |= ^= :: .* <=>",
    "java": "<<= ... -> ++ -- && || == != <= >= << += -= *= /= %= &= |= ^= ::",
    "csharp": "<<= ... => -> ++ -- && || == != <= >= << += -= *= /= %= &= |= ^= :: ??= ?? ?. ..",
    "go": "<<= >>= &^= ... := <- ++ -- && || == != <= >= << >> &^ += -= *= /= %= &= |= ^=",
    "javascript": ">>>= <<= >>= **= &&= ||= ??= ... === !== >>> => ++ -- && || == != <= >= << >> ** ?. ?? += -= *= /= %= &= |= ^=",
    "typescript": "<<= **= &&= ||= ??= ... === !== => ++ -- && || == != <= >= << ** ?. ?? += -= *= /= %= &= |= ^=",
    "php": "<=> **= ... <<= >>= === !== ??= ?-> => -> ++ -- && || == != <> <= >= << >> ** ?? :: += -= *= /= .= %= &= |= ^=",
    "rust": "..= ... <<= => -> && || == != <= >= << += -= *= /= %= &= |= ^= :: ..",
    "scala": "=> <- <: >: <% ++ -- && || == != <= >= << >> :: ::: :+ +: ++: += -= *= /= %= &= |= ^= ->",
    "python": "**= //= >>= <<= ... -> := ** // == != <= >= << >> += -= *= /= %= &= |= ^= @=",
    "ruby": "**= <=> === ... <<= >>= &&= ||= => -> ** == != =~ !~ <= >= << >> && || .. :: &. += -= *= /= %= &= |= ^=",
}
_BINARY = "/ % == != === !== <= >= && || ^ << >> >>> // <=> ?? <> =~ !~ ##"
_ASSIGN = "+= -= *= /= %= &= |= ^= <<= >>= >>>= **= //= &&= ||= ??= .= @= &^= "
#: What an operator counts as; others stand for themselves.
CLASSES = {**dict.fromkeys(_BINARY.split(), "bop"), **dict.fromkeys(_ASSIGN.split(), "asg"), "++": "inc", "--": "inc"}
OWN = {
    "c": {"|": "bop", "##": "##"}, "cpp": {"|": "bop", ">=": ">=", "->*": "bop", ".*": "bop", "&&": "&&"}, "java": {"|": "bar", ">=": ">="}, "csharp": {"|": "bop", ">=": ">="}, "go": {"|": "bar", "&^": "bop", "^": "^"},
    "javascript": {"|": "bop"}, "typescript": {"|": "bar", ">=": ">="}, "php": {"|": "bar", "/": "bop"}, "rust": {"|": "bar", ">=": ">=", "||": "||", "&&": "&&", "^": "bop"}, "scala": {"++": "bop", "--": "bop", "|": "bar", "::": "bop", ":::": "bop", ":+": "bop", "+:": "bop", "++:": "bop", "->": "bop"},
    "python": {"|": "bop"}, "ruby": {"|": "bar", "||": "||"},
}

_C = """
Cx: X | Cx , X
X: B | B ? Cx : X | B ? : X | B asg X | B = X
B: U | B Bop U
Bop: bop | * | & | < | > | + | -
U: P | Uop U | CAST U | CAST LST | sizeof U | sizeof TYP | sizeof TYP LST
Uop: ! | ~ | - | + | * | & | inc | __extension__
P: id | num | Str | EXP | P ARGS | P IDX | P . id | P -> id | P inc | . num | STM | TYA
Str: str | Str str | Str id str | id str str
Q: const | static | extern | inline | volatile | register | restrict | Att | __extension__
Att: __attribute__ ATT
Ty0: int | char | void | long | short | float | double | unsigned | signed
Tys: Ty0 | Tys Ty0 | Tys Q
Base: Tys | id | Agg | id ARGS
Agg: Kw Att* id? FLD Att* | Kw Att* id | enum Att* id? ENU Att* | enum id
Kw: struct | union
Spec: Base | Q Spec | Spec Q
Star: * Q*
D: Dp Att* | Dp Att* = X | Dp Att* = LST | Dp Att* : X | : X | Dp Asm Att*
Asm: asm ARGS | __asm__ ARGS
Dp: Dn | Star Dp
Dn: id | DPAR | Dn DIM | Dn PARS
Ds: D | Ds , D
Abs: Star+ | Star* An
An: DABS | An PARS | An DIM | DIM | PARS
Par: Spec | Spec Dp Att* | Spec Abs | ... | id | Spec Dp id
Pars: Par | Pars , Par
Tn: Spec | Spec Abs
Fn: Spec Dp Att* BLK | Q Dp BLK | id PARS BLK | Spec Dp Kr+ BLK | Q Tys id Dp BLK | Q id Base Dp BLK
Kr: Spec Ds ;
Decl: Spec Ds ; | Spec ; | typedef Spec Ds ; | typedef Spec ; | Q Dp ;
If: if COND S | if COND S else S
Asmb: asm Q* ATT ; | __asm__ Q* ATT ; | asm goto ATT ;
S: BLK | Cx ; | Decl | If | for FORH S | while COND S | do S while COND ; | switch COND S | break ; | continue ; | return ; | return Cx ; | goto id ; | goto * X ; | id : S | id : | Lab S | Lab | ; | Asmb | Fn | return LST ;
Lab: case X : | case X ... X : | default :
T: Decl | Fn | ; | extern str EXT | id ARGS ; | id ARGS | Asmb | extern str Decl
F: Spec Ds ; | Spec ; | ; | id ARGS ;
Fi: Cx | Spec Ds
For: Fi? ; Cx? ; Cx?
Li: X | LST | . id = X | . id = LST | IDX = X | IDX = LST | Des = X | Des = LST | IDX X | id : X
Des: . id Des1 | IDX Des1
Des1: . id | IDX | Des1 . id | Des1 IDX
Ls: Li | Ls , Li
L: Ls | Ls ,
En: id | id = X | id Att
Ens: En | Ens , En
E: Ens | Ens ,
As: A | As , A
A: X | Tn | LST | *
Any: Cx | Tn | Any : | Any : Any | Any , Any
"""
_C_GROUPS = """
ARGS ( As? | EXP ( Cx | COND ( Cx | PARS ( Pars? | CAST ( Tn | TYP ( Tn | DPAR ( Dp | DABS ( Abs | FORH ( For | ATT ( ATT* | STM ( BLK | TYA ( TYA0
IDX [ Ix | DIM [ Dm? | BLK { S; | FLD { F; | LST { L? | ENU { E | EXT { T;
"""
_CPP = """
Cx: X | Cx , X
X: B | B ? Cx : X | B asg X | B = X | B asg LST | B = LST | B > >= X | throw X? | co_yield X
B: U | B Bop U
Bop: bop | * | & | && | < | > | > > | + | - | >=
U: P | Uop U | CAST U | sizeof U | sizeof TYP | sizeof ... TYP | New | Del | co_await U | alignas TYP
Uop: ! | ~ | - | + | * | & | inc | && | __extension__
New: Glob? new ARGS? Tn2 | Glob? new ARGS? Tn2 ARGS | Glob? new ARGS? Tn2 LST | new TYP ARGS?
Glob: ::
Tn2: Tspec | Tn2 Star | Tn2 IDX
Del: Glob? delete U | Glob? delete DIM U
P: Qid | num | Str | this | true | false | nullptr | EXP | FOLD | P ARGS | P IDX | P . Mem | P -> Mem | P inc | . num | Lam | Tspec ARGS | Tspec LST | Ty0 ARGS | typename Qid ARGS | P LST | operator Opn | decltype ARGS | requires PARS? BLK | noexcept ARGS
Mem: Qid | template Qid | ~ id | operator Opn | * Qid
Str: str | Str str | Str id str | id Str
Opn: + | - | * | bop | & | && | < | > | = | asg | ! | ~ | inc | , | EMPTY | DIM | -> | > > | > > = | > = | new | delete | str id | Tn | new DIM | delete DIM | ->*
Nm: id | id Ta | final | override
Ta: < Tas > | < >
Tas: Targ | Tas , Targ
Targ: Tn | Tn ... | B0 | B0 ...
B0: U | B0 Bop0 U
Bop0: bop | * | & | && | + | -
Qid: Nm | Glob Nm | Qid :: Nm | Qid :: template Nm | Qid :: ~ id | Qid :: operator Opn | Qid :: * | Qid :: operator Opn Ta | ~ id | decltype ARGS :: Nm
Lam: IDX LamT? ARGS? LamQ* Ret? BLK | IDX LamT? PARS LamQ* Ret? BLK | DIM LamT? ARGS? LamQ* Ret? BLK | DIM LamT? PARS LamQ* Ret? BLK | CAPT LamT? PARS? LamQ* Ret? BLK
LamT: < Tps >
LamQ: mutable | noexcept | noexcept ARGS | constexpr | Att
Ret: -> Tn
Q: const | static | extern | inline | volatile | register | constexpr | explicit | friend | virtual | mutable | thread_local | Att | consteval | constinit | explicit ARGS | __extension__ | typedef
Att: __attribute__ ATT | ATTB | alignas ARGS
Ty0: int | char | void | long | short | float | double | unsigned | signed | bool | auto
Tys: Ty0 | Tys Ty0 | Tys Q
Tspec: Qid | typename Qid | Tys | decltype ARGS | Agg | id ARGS | Qid auto | enum Qid
Key: struct | class | union
Agg: Key Att* Hd? Bases? FLD | Key Att* Qid | enum Key? Att* Qid? Und? ENU | enum Key Qid Und?
Hd: Qid | Qid final | id Qid | id ARGS Qid | id Qid final
Und: : Tn
Bases: : Bs
Bs: Bb | Bs , Bb
Bb: Bq* Tspec | Bq* Tspec ...
Bq: public | private | protected | virtual
Spec: Tspec | Q Spec | Spec Q
Star: * Q* | & Q* | && Q* | Qid :: * Q* | ...
D: Dp Da* | Dp Da* = X | Dp Da* = LST | Dp LST | Dp Da* : X | : X | Dp ARGS
Da: Att | const | noexcept | noexcept ARGS | override | final | & | && | volatile | Ret | throw PARS | requires B
Dp: Dn | Star Dp
Dn: Qid | DPAR | Dn DIM | Dn IDX | Dn PARS | operator Opn | Qid ... | SBIND | Att Dn
Ds: D | Ds , D
Abs: Star+ | Star* An
An: DABS | An PARS | An DIM | DIM | PARS | An IDX | IDX
Par: Spec | Spec Dp Att* | Spec Abs | ... | Spec Dp = X | Spec Dp = LST | Spec = X | Spec Abs = X | Spec = LST | this Spec Dp
Pars: Par | Pars , Par
Tn: Spec | Spec Abs
Fend: BLK | Inits BLK | try BLK Cat+ | try Inits BLK Cat+
Inits: : Is
Is: Ii | Is , Ii
Ii: Qid ARGS | Qid LST | Qid ARGS ... | Tspec ARGS
Fn: Spec? Dp Da* Fend | Q+ Dp Da* Fend
Fsp: = default | = delete | = num
Tmpl: template < Tps > Req? | template < >
Req: requires B
Tps: Tp | Tps , Tp
Tp: typename ...? id? | class ...? id? | typename id? = Tn | class id? = Tn | Par | Tmpl class id? | Tmpl typename id? | Qid ...? id | id = B0
Decl: Spec Ds ; | Spec ; | Spec? Dp Da* ; | Spec? Dp Da* Fsp ; | Q+ Dp Da* ; | Q+ Dp Da* Fsp ; | Us | Sa | Tmpl Decl | Tmpl Fn | template Decl | extern template Decl | friend Spec ; | concept id = X ; | Tmpl concept id = X ; | Att ;
Us: using Qid ; | using namespace Qid ; | using id Att* = Tn ; | Tmpl using id Att* = Tn ; | using typename Qid ; | using enum Qid ; | namespace id = Qid ; | using Qs ;
Qs: Qid , Qid | Qs , Qid
Sa: static_assert ARGS ;
If: if Cex? COND S | if Cex? COND S else S
Cex: constexpr | ! constexpr
S: BLK | Cx ; | Decl | If | for FORH S | while COND S | do S while COND ; | switch COND S | break ; | continue ; | return ; | return Cx ; | return LST ; | co_return ; | co_return Cx ; | goto id ; | id : S | id : | Lab S | Lab | ; | try BLK Cat+ | Att S | Fn
Cat: catch PARS BLK
Lab: case X : | case X ... X : | default :
T: Decl | Fn | ; | extern str EXT | extern str Decl | extern str Fn | inline? namespace Att* Qid? EXT | id ARGS ;? | id | Acc
Acc: public : | private : | protected : | public id : | id :
F: Decl | Fn | ; | Acc | id ARGS ; | id ARGS | friend Fn | Acc F
Fi: Cx | Spec Ds
For: Fi? ; Cx? ; Cx? | Spec Dp : X | Spec Dp : LST | Fi ; Spec Dp : X
Cond: Cx | Spec Dp = X | Spec Dp = LST | Spec Dp LST | Fi ; Cx | Fi ; Spec Dp = X
Li: X | LST | . id = X | . id LST | X ... | IDX = X
Ls: Li | Ls , Li
L: Ls | Ls ,
En: id | id = X | id Att = X | id Att
Ens: En | Ens , En
E: Ens | Ens ,
As: A | As , A
A: X | Tn | LST | X ... | B ... | EXP ...
Cap: = | & | this | * this | & id | id | id = X | & id = X | X ... | & id ...
Caps: Cap | Caps , Cap
Fold: ... Bop U | U Bop ... | U Bop ... Bop U
Bnd: id | Bnd , id
Ix: X | LST | Cx
"""
_CPP_GROUPS = """
ARGS ( As? | EXP ( Cx | EMPTY ( EMPTY? | COND ( Cond | PARS ( Pars? | CAST ( Tn | TYP ( Tn | DPAR ( Dp | DABS ( Abs | FORH ( For | FOLD ( Fold | ATT ( ATT*
IDX [ Ix | DIM [ Ix? | CAPT [ Caps? | SBIND [ Bnd | ATTB [ ATT* | BLK { S; | FLD { F; | LST { L? | ENU { E? | EXT { T;
"""
_JAVA = """
X: L1 | Lam | U asg X | U = X | U > > = X | U > > > = X | U > >= X | U > > >= X
L1: B | B ? X : X | B ? X : Lam
B: U | B Bop U | B instanceof Pat | B instanceof Pm+ Pat
Bop: bop | * | & | < | > | + | - | bar | > > | > > > | >=
U: P | Uop U | CAST U | CAST Lam | switch EXP SWB
Uop: ! | ~ | - | + | inc
P: id | num | str | EXP | id ARGS | P . Im | P . Im ARGS | P . Gen Im ARGS | P IDX | P inc | new Crea | Ty . class | Ty0 . class | Rt :: Im | Rt :: new | P . new Crea | Arr :: new | . num
Im: id | record | yield
Rt: P | Ty
Crea: Ann* Cn ARGS CLS? | Ann* T0 IDX+ DIM* | Ann* T0 DIM+ LST | Gen Cn ARGS
Arr: T0 DIM+
Lam: Im -> X | Im -> BLK | LPAR -> X | LPAR -> BLK
Ty: Ann* T0 Dd*
Dd: Ann* DIM
T0: Ty0 | Cn
Ty0: int | char | void | long | short | float | double | boolean | byte
Cn: id | id Gen | Cn . Ann* id | Cn . Ann* id Gen | record
Gen: < Gs > | < >
Gs: Ga | Gs , Ga
Ga: Gb | Ann* ? | Ann* ? extends Gb | Ann* ? id Gb
Gb: Ty | Gb & Ty
Tps: Tp | Tps , Tp
Tp: Ann* id | Ann* id extends Gb
TP: < Tps >
Ann: @ Dot | @ Dot ARGS
Dot: id | Dot . id
Av: X | Ann | LST | id = X | id = LST | id = Ann
Avs: Av | Avs , Av
Pm: final | Ann
Mod: public | private | protected | static | final | abstract | synchronized | native | transient | volatile | strictfp | default | Ann | Seal
Seal: id - id
Par: Pm* Ty Im Dd* | Pm* Ty ... Im | Pm* Ty Ann* ... Im | Ty id . id
Pars: Par | Pars , Par
Ids: Im | Ids , Im
Lps: Ids | Pars
D: Im Dd* | Im Dd* = X | Im Dd* = LST
Ds: D | Ds , D
Pat: Ty | Ty Im | Ty RPAT | Ty RPAT id
Pats: Pat | Pats , Pat
Lv: X | Pat | Pm+ Ty id | default
Lvs: Lv | Lvs , Lv
Lab: case Lvs : | default : | case Lvs id X :
Arw: case Lvs -> | default -> | case Lvs id X ->
If: if EXP S | if EXP S else S
Cat: catch CATP BLK
Res: Pm* Ty id = X | P
Ress: Res | Ress ; Res | Ress ;
Ct: Ty | Ct bar Ty
Catp: Pm* Ct id
S: BLK | X ; | Pm* Ty Ds ; | If | while EXP S | do S while EXP ; | for FORH S | switch EXP SWB | try RES? BLK Cat* Fin? | throw X ; | return ; | return X ; | break id? ; | continue id? ; | assert X ; | assert X : X ; | synchronized EXP BLK | id : S | Cls | yield X ; | ;
Fin: finally BLK
W: S | Lab W | Lab | Arw X ; | Arw BLK | Arw throw X ;
Xs: X | Xs , X
Fi: Xs | Pm* Ty Ds
For: Fi? ; X? ; Xs? | Pm* Ty Im : X
Tl: Ty | Tl , Ty
Ext: extends Tl
Imp: implements Tl
Prm: id Tl
Thr: throws Tl
Cls: Mod* class id TP? Ext? Imp? Prm? CLS | Mod* interface id TP? Ext? Prm? CLS | Mod* enum id Imp? ENU | Mod* record id TP? PARS Imp? CLS | Mod* @ interface id CLS
M: Mod* TP? Ty Im PARS Dd* Thr? BLK | Mod* TP? Ty Im PARS Dd* Thr? ; | Mod* TP? Ty Im PARS default X ; | Mod* TP? Ty Im PARS default LST ; | Mod* TP? Ty Im PARS default Ann ; | Mod* TP? id PARS Thr? BLK | Mod* id BLK | Mod* Ty Ds ; | Cls | static? BLK | ;
T: Ann* package Dot ; | import static? Dot ; | import static? Dot . * ; | Cls | ; | id id Dot RB | Mod* Ty id PARS Thr? BLK
RB: BLK
Cst: Ann* id ARGS? CLS?
Csts: Cst | Csts , Cst
En: Csts ; | Csts , ; | ; | M
Li: X | LST | Ann
Ls: Li | Ls , Li
L: Ls | Ls , | ,
As: X | As , X
"""
_JAVA_GROUPS = """
ARGS ( As? | EXP ( X | PARS ( Pars? | LPAR ( Lps? | CAST ( Gb | RPAT ( Pats? | CATP ( Catp | RES ( Ress | FORH ( For | ANN ( Avs?
IDX [ X | DIM [ DIM? | BLK { S; | CLS { M; | LST { L? | ENU { En; | SWB { W;
"""
_GO = """
X: U | X Bop U
Xh: Uh | Xh Bop Uh
Bop: bop | * | & | < | > | + | - | bar | ^
U: P | Uop U
Uh: Ph | Uop Uh
Uop: ! | ^ | - | + | * | & | <-
P: id | num | str | EXP | P ARGS | P IDX | P SLC | P . id | P TARG | P . TYP | Lit LST | Own LST | func PARS Res? BLK | . num | Con ARGS | TYP
Ph: id | num | str | EXP | Ph ARGS | Ph IDX | Ph SLC | Ph . id | Ph TARG | Ph . TYP | Own LST | func PARS Res? BLK | . num | Con ARGS | TYP
Own: Arr | map IDX Ty | map TARG Ty | struct FLD
Lit: id | id . id | id TARG | id . id TARG | id IDX | id . id IDX
Arr: DIM Ty | IDX Ty | ELL Ty
Con: Arr | chan Ty | map IDX Ty | map TARG Ty | func PARS Res? | interface ITF | struct FLD | <- chan Ty | chan <- Ty
Ty: id | id . id | id TARG | id . id TARG | id IDX | id . id IDX | * Ty | Arr | map IDX Ty | map TARG Ty | func PARS Res? | interface ITF | struct FLD | chan Ty | chan <- Ty | <- chan Ty | TYP
Res: Ty | PARS
As: A | As , A
A: X | Ty | X ... | Con
Al: As | As ,
Tas: Ty | Tas , Ty
Tal: Tas | Tas ,
Par: Ty | id Ty | ... Ty | id ... Ty
Pars: Par | Pars , Par
Pal: Pars | Pars ,
Un: Te | Un bar Te
Te: Ty | ~ Ty
Tp: Ids Un
Tps: Tp | Tps , Tp
Tpl: Tps | Tps ,
Ids: id | Ids , id
Xs: X | Xs , X
Sim: X | Xs asg Xs | Xs = Xs | Xs := Xs | X inc | X <- X
Xsh: Xh | Xsh , Xh
Simh: Xh | Xsh asg Xsh | Xsh = Xsh | Xsh := Xsh | Xh inc | Xh <- Xh
Pre: Simh ; | ;
If: if Xh BLK | if Pre Xh BLK | If0 else BLK | If0 else If
If0: if Xh BLK | if Pre Xh BLK
For: for BLK | for Xh BLK | for Simh? ; Xh? ; Simh? BLK | for Rng BLK
Rng: Xsh := range Xh | Xsh = range Xh | range Xh
Sw: switch Xh? SWB | switch Pre Xh? SWB | switch Tsw SWB | switch Pre Tsw SWB | select SEL
Tsw: id := Ph . TYPE | Ph . TYPE
V: var Ids Ty | var Ids Ty = Xs | var Ids = Xs | var VARS | const Ids Ty? = Xs | const CONS | const id
Tyd: type id Ty | type id = Ty | type id TPAR Ty | type id IDX Ty | type TYPS | type id TPAR = Ty
S: Sim ; | If ; | For ; | Sw ; | return ; | return Xs ; | break id? ; | continue id? ; | goto id ; | fallthrough ; | V ; | Tyd ; | go X ; | defer X ; | BLK ; | id : S | id : | ;
Lab: case Tas : | case Xs : | default : | case Mix :
Mix: A | Mix , A
W: Lab W | Lab | S
Cl: case Sim : | default :
Se: Cl Se | Cl | S
T: package id ; | import Imp ; | import IMPS ; | Fn ; | V ; | Tyd ; | ;
Imp: str | id str | . str
Fn: func id PARS Res? BLK | func id PARS Res? | func id TPAR PARS Res? BLK | func id IDX PARS Res? BLK | func PARS id PARS Res? BLK | func PARS id PARS Res?
F: Ids Ty str? ; | Emb str? ; | ;
Emb: id | id . id | * id | * id . id | id TARG | id . id TARG | id IDX | * id TARG | * id IDX | id . id IDX
I: id PARS Res? ; | Un ; | ;
Im: Imp ; | ;
Vd: Ids Ty ; | Ids Ty = Xs ; | Ids = Xs ; | ;
Cd: Ids ; | Ids Ty? = Xs ; | ;
Td: id Ty ; | id = Ty ; | id TPAR Ty ; | ;
Li: Lk | Lk : Lk
Lk: X | LST
Ls: Li | Ls , Li
L: Ls | Ls ,
Sl: X? : X? | X? : X : X | :
Tsx: type
"""
_GO_GROUPS = """
ARGS ( Al? | EXP ( X | PARS ( Pal? | TYP ( Ty | TYPE ( Tsx | IMPS ( Im; | VARS ( Vd; | CONS ( Cd; | TYPS ( Td;
IDX [ X | SLC [ Sl | DIM [ DIM? | ELL [ Elp | TARG [ Tal | TPAR [ Tpl | BLK { S; | LST { L? | FLD { F; | ITF { I; | SWB { W; | SEL { Se;
"""
_JS = """
Cx: X | Cx , X
X: B | B ? X : X | U Asg X | Arrow | yield | yield X | yield * X
Asg: asg | =
B: U | B Bop U
Bop: bop | * | & | < | > | + | - | in | instanceof | **
U: P | Uop U
Uop: ! | ~ | - | + | inc | typeof | void | delete | await
P: Id | num | str | tpl | EXP | P ARGS | P IDX | P . Name | P ?. Name | P ?. ARGS | P ?. IDX | P inc | ARR | OBJ | Fn | Cl | P tpl | new Nw | new . id | import ARGS | import . id | priv in U | . num | P . priv | P ?. priv
Nw: P | new Nw
Id: id | get | set | of | from | as | async | static | let
Name: Id | if | else | for | while | do | return | break | continue | switch | case | default | class | extends | new | import | export | function | var | const | throw | try | catch | finally | await | in | typeof | void | delete | instanceof | yield | debugger | with | enum
Aop: async
Arrow: Id => Abody | async Id => Abody | PARS => Abody | async PARS => Abody | async ARGS => Abody
Abody: X | BLK
Fn: function *? Id? PARS BLK | async function *? Id? PARS BLK | function * Id? PARS BLK | async function * Id? PARS BLK
Cl: class Id? CLS | class Id? extends U CLS | Dec Cl
Dec: @ P
Bt: Id | OBJ | ARR
D: Bt | Bt = X
Ds: D | Ds , D
Let: let | const | var
Par: Bt | Bt = X | ... Bt
Pars: Par | Pars , Par
Pal: Pars | Pars ,
As0: Ae | As0 , Ae
Ae: X | ... X
As: As0 | As0 ,
El: Es | Ec | Ec Es
Ec: , | Es , | Ec , | Ec Es ,
Es: Ae
If: if EXPS S | if EXPS S else S
For: Fi? ; Cx? ; Cx? | Let Bt of X | Let Bt in Cx | U of X | U in Cx
Fi: Cx | Let Ds
S: BLK | Cx ; | Let Ds ; | If | for FORH S | for await FORH S | while EXPS S | do S while EXPS ; | do S while EXPS | return ; | return Cx ; | throw Cx ; | break Id? ; | continue Id? ; | switch EXPS SWB | try BLK Cat? Fin? | Fn | Cl | Id : S | debugger ; | with EXPS S | Imx | ;
Cat: catch BLK | catch CAT BLK
Fin: finally BLK
Lab: case Cx : | default :
W: S | Lab W | Lab
Imx: import str With? ; | import Imp from str With? ; | export OBJ With0? ; | export OBJ from str With? ; | export * from str With? ; | export * as Name from str With? ; | export default X ; | export default Fn | export default Cl | export Fn | export Cl | export Let Ds ; | export NMS ; | export NMS from str With? ; | export * as str from str ; | Dec export Cl
With: with OBJ
With0: with OBJ
Imp: Id | NMS | * as Id | Id , NMS | Id , * as Id
Nm: Name | Name as Name | Name as str | str as Name | str
Nms: Nm | Nms , Nm
Nml: Nms | Nms ,
Mn: Name | str | num | IDX | priv
Km: static | async | get | set | *
M: Dec* Km* Mn PARS BLK | Dec* static? Mn ; | Dec* static? Mn = X ; | static BLK | ;
Pr: Name | Name = X | Mn : X | ... X | Km* Mn PARS BLK
Prs: Pr | Prs , Pr
L: Prs | Prs ,
Cp: Bt
"""
_JS_GROUPS = """
ARGS ( As? | EXP ( Cx | EXPS ( Cx | PARS ( Pal? | FORH ( For | CAT ( Cp
IDX [ Cx | ARR [ El? | BLK { S; | OBJ { L? | CLS { M; | SWB { W; | NMS { Nml?
"""
_TS_MORE = """
Asx: as | satisfies
Bop: > > | > > > | >= | bar
Asg: > >= | > > >=
B: B Asx Ty | B Asx const
P: P ! | P Targ ARGS | P Targ tpl | TCAST | new Cn Targ | P Targ | PARS0
Targ: < Tyl >
U: < Ty > U
Cn: P
Id: type | interface | public | private | protected | readonly | abstract | declare | namespace | module | is | keyof | infer | satisfies | asserts | override | unique | global | accessor
Name: implements
Arrow: PARS : Rt => Abody | async PARS : Rt => Abody | TP PARS Ret? => Abody | async TP PARS Ret? => Abody | async ARGS : Rt => Abody
Ret: : Rt
Rt: Ty | asserts Id | asserts Id is Ty | Id is Ty
Fn: function Id? TP? PARS Ret? BLK | async function Id? TP? PARS Ret? BLK | function * Id? TP? PARS Ret? BLK | async function * Id? TP? PARS Ret? BLK
Cl: abstract? class Id? TP? Ext? Impl? CLS
Ext: extends U | extends U Targ
Impl: implements Tyl
D: Bt Ann | Bt Ann = X | Bt ! Ann
Ann: : Ty
Par: Pmod+ Bt | Pmod+ Bt = X | Pmod* Bt ? | Pmod* Bt ?? Ann = X | Pmod* Bt Ann | Pmod* Bt Ann = X | Pmod* Bt ? Ann | ... Bt Ann | this | Dec Par
Pmod: public | private | protected | readonly | override
For: Let Bt Ann of X | Let Bt Ann in Cx
Tyl: Ty | Tyl , Ty
Ty: Un | Un extends Un ? Ty : Ty | Un extends infer Id extends Un ? Ty : Ty | FPAR => Rt | TP FPAR => Rt | new FPAR => Ty | abstract? new TP? FPAR => Ty
Un: In | Un bar In | bar In
In: Po | In & Po | & Po
Po: T1 | keyof Po | unique Po | readonly Po | infer Id | typeof Tq | typeof Tq Targ | infer Id extends Po
Tq: Id | Tq . Name | import ARGS | Tq IDX
T1: Tn | Tn Targ | T1 AIDX | T1 TIDX | TOBJ | FLD | MAP | str | tpl | num | - num | TPAR | void | TUP | import ARGS | import ARGS . Tn | import ARGS . Tn Targ | asserts Id
Tn: Id | Tn . Name
TP: < Tps > | < Tps , >
Tps: Tp | Tps , Tp
Tp: const? Id | Id extends Ty | Id = Ty | Id extends Ty = Ty | in Id | const Id extends Ty
Tpd: S
S: Dcl | declare Dcl | export Dcl | export declare Dcl | export default Dcl | export = X ; | export as namespace Id ; | import type Imp from str ; | export type NMS ; | export type NMS from str ; | export type * from str ; | import Id = Tq ; | export import Id = Tq ; | declare Let Ds ; | export declare Let Ds ; | declare Fn | declare global EXTB | import Id = id ARGS ; | import type Id = Tq ; | abstract? Cl | export abstract? Cl | export default abstract Cl
Dcl: interface Id TP? Iext? FLD | type Id TP? = Ty ; | const? enum Id ENU | namespace Tq EXTB | module Tq EXTB | module str EXTB | module str ; | async? function *? Id? TP? PARS Ret? ; | abstract? class Id? TP? Ext? Impl? CLS | Let Ds ; | function Id? TP? PARS Ret? ;
Iext: extends Tyl
Nm: type Name | type Name as Name
En: Mn | Mn = X
Ens: En | Ens , En
Enl: Ens | Ens ,
Cmod: public | private | protected | readonly | static | abstract | declare | override | async | get | set | * | accessor
M: Dec* Cmod* Mn Opt? Ann? ; | Dec* Cmod* Mn Opt? Ann? = X ; | Dec* Cmod* Mn Opt? TP? PARS Ret? BLK | Dec* Cmod* Mn Opt? TP? PARS Ret? ; | Cmod* INDEX Ann ;
Opt: ? | !
Pr: Mn Targ ARGS | async? Mn TP? PARS Ret? BLK | get Mn PARS Ret? BLK | set Mn PARS BLK | * Mn TP? PARS Ret? BLK | async * Mn TP? PARS Ret? BLK
F: Fm Sep | Sep
Sep: ; | ,
Fm: Rd? Mn Opt? Ann | Mn Opt? TP? PARS Ret? | TP? PARS Ret? | new TP? PARS Ret? | Rd? INDEX Opt? Ann | Rd? Mn Opt? | get Mn PARS Ret? | set Mn PARS
Rd: readonly | - readonly | + readonly
Ind: Id : Ty
Fpar: Par | Id ? | Fpar , Par
Fpl: Fpar | Fpar ,
Mapk: Mrd? MKEY Mq? Ann ;
Mrd: readonly | - readonly | + readonly
Mq: ? | - ? | + ?
Mk: Id in Ty | Id in Ty as Ty
Tue: Ty | ... Ty | Id : Ty | Id ? : Ty | ... Id : Ty | Ty ?
Tues: Tue | Tues , Tue
Tul: Tues | Tues ,
Cp: Bt Ann
"""
_TS_GROUPS = _JS_GROUPS + """
TPAR ( Ty | FPAR ( Fpl? | AIDX [ AIDX? | TIDX [ Ty | TUP [ Tul? | INDEX [ Ind | MKEY [ Mk | TOBJ { F; | FLD { F; | MAP { Mapk; | ENU { Enl? | EXTB { S;
"""
_PHP = """
X: B | B ? X : X | B ? : X | U Asg X | U = & U | throw X | print X | yield | yield X | yield X => X | Inc X | fn &? PARS Ret? => X | static fn PARS Ret? => X
Inc: include | include_once | require | require_once
Asg: asg | =
B: U | B Bop U | B instanceof P
Bop: bop | * | & | < | > | + | - | . | bar | ** | and | or | xor
U: P | Uop U | CAST U | new P | new Anon | clone U
Uop: ! | ~ | - | + | inc | & | @
Anon: class ARGS? Ext? Impl? CLS | Attr class ARGS? Ext? Impl? CLS
P: var | Nm | num | str | tpl | EXP | P ARGS | P IDX | P DIM | P -> Mem | P ?-> Mem | P :: Mem | P :: class | P inc | ARR | DIM | Fun | isset ARGS | unset ARGS | list ARGS | array PAIRS | match EXP MAT | static | $ P | $ BLKX | P BLKX | . num
Mem: id | var | BLKX | class | list | print | default | new | array | use | echo | for | if | match | $ var | as | and | or | unset | isset | return | include | require | function | const | empty | switch | case | var | global | static | extends | clone | try | catch | throw | do | while | foreach | continue | break | else | public | private | protected | final | abstract | interface | namespace | enum | goto | declare | yield | fn | readonly | trait | instanceof | implements | include_once | require_once | xor | elseif | finally
Nm: id | Nm \\ id | \\ id | namespace \\ id | enum | readonly | Nm \\ Mem
Fun: static? function &? PARS Use? Ret? BLK | Attr Fun
Use: use USES
Ret: : Ty
Ty: T1 | ? T1 | Ty bar T1 | Ty & T1
T1: Nm | array | static | TPAR
Attr: # ATTB
Par: Pm* Ty? &? ...? var | Pm* Ty? &? var = X
Pm: public | private | protected | readonly | Attr | final
Pars: Par | Pars , Par
Pal: Pars | Pars ,
A: X | ... X | Mem : X | ...
As0: A | As0 , A
As: As0 | As0 ,
E: X | X => X | & U | X => & U | ... X
Es: E | Es , E | Es , | ,
El: Es | , Es
Ma: Mc => X | default => X | default , => X
Mc: X | Mc , X
Mas: Ma | Mas , Ma
Mal: Mas | Mas ,
Xs: X | Xs , X
If: if EXP S | if EXP S Ei* else S | if EXP S Ei+
Ei: elseif EXP S | else if EXP S
Alt: if EXP : | elseif EXP : | else : | for FORH : | foreach FE : | while EXP : | endif ; | endfor ; | endforeach ; | endwhile ; | endswitch ; | switch EXP :
Fe: X as Ft | X as Ft => Ft
Ft: U | & U | ARR
For: Xs? ; Xs? ; Xs?
Cat: catch CATP BLK
Ct: Ty var?
Fin: finally BLK
S: BLK | X ; | If | Alt | while EXP S | do S while EXP ; | for FORH S | foreach FE S | switch EXP SWB | break num? ; | continue num? ; | return ; | return X ; | echo Xs ; | global Xs ; | static Svs ; | try BLK Cat* Fin? | Fd | Cls | const Cs ; | namespace Nm ; | namespace Nm? BLK | use UseL ; | declare ARGS ; | declare ARGS BLK | goto id ; | id : | ; | unset ARGS ;
Svs: Sv | Svs , Sv
Sv: var | var = X
Cs: Ci = X | Cs , Ci = X
Ci: id | Mem
UseL: UseI | UseL , UseI
UseI: Uk? Nm | Uk? Nm as id | Uk? Nm \\ UGRP
Uk: function | const
Ug: Nm | Nm as id | Ug , Nm | Ug , Nm as id | Ug ,
Fd: Attr* function &? Mem PARS Ret? BLK
Ext: extends Nms
Impl: implements Nms
Nms: Nm | Nms , Nm
Cm: abstract | final | readonly
Cls: Attr* Cm* class id Ext? Impl? CLS | Attr* interface id Ext? CLS | Attr* trait id CLS | Attr* enum id Ret? Impl? CLS
Mod: public | private | protected | static | final | abstract | var | readonly
Pv: var | var = X
Pvs: Pv | Pvs , Pv
M: Attr* Mod* function &? Mem PARS Ret? BLK | Attr* Mod* function &? Mem PARS Ret? ; | Attr* Mod+ Ty? Pvs ; | Attr* Mod* const Ty? Cs ; | use Nms ; | use Nms INS | Attr* case id ; | Attr* case id = X ;
In: Nm :: Mem insteadof Nms ; | Nm :: Mem as Mem ; | Nm as Mem ; | Mem as Mod Mem? ; | Nm :: Mem as Mod Mem? ;
Lab: case X : | default : | case X ; | default ;
W: S | Lab
Ut: var | & var
Uts: Ut | Uts , Ut | Uts ,
Cst: id | array
"""
_PHP_GROUPS = """
ARGS ( As? | EXP ( X | PARS ( Pal? | CAST ( Cst | PAIRS ( El? | USES ( Uts? | FE ( Fe | FORH ( For | CATP ( Ct | TPAR ( Ty
IDX [ X | DIM [ DIM? | ARR [ El? | ATTB [ ATT* | BLK { S; | BLKX { X | CLS { M; | SWB { W; | MAT { Mal? | INS { In; | UGRP { Ug
"""
_RUST = """
X: B | U Asg X | U = X | Jmp | Clo | Rg
Asg: asg | > > = | > >=
B: U | B Bop U | B as Ty
Rg: B .. | B .. B | .. B | .. | B ..= B | ..= B | B ... B
Bop: bop | * | & | < | > | + | - | bar | > > | && | || | >=
U: P | Uop U
Uop: ! | - | * | & | & mut | && | && mut | & Raw
Raw: id const | id mut
Jmp: return X? | break life? X? | continue life?
Clo: Cm* Cpar CloB | Cm* Cpar -> Ty BLK
Cm: move | async | static
Cpar: || | bar Cps? bar | bar Cps , bar
Cps: Cp | Cps , Cp
Cp: Pt0 | Pt0 : Ty
CloB: X
P: Path | num | str | EXP | ARGS | P ARGS | P IDX | P . id | P . num | P . await | P . id :: Ta ARGS | P ? | ARR | Path SLIT | Mac | Blkx | P . self
Blkx: BLK | unsafe BLK | async move? BLK | const BLK | Life? loop BLK | Life? while Cnd BLK | Life? for Pat in Cnd BLK | If | match Cnd MAT | life : BLK | Attr Blkx
Life: life :
If: if Cnd BLK | if Cnd BLK else BLK | if Cnd BLK else If
Cnd: X | let Pat = X | Cnd && let Pat = X
Mac: Path ! TTP | Path ! TTB | Path ! TTC | Path ! id TTC
Nm: id | self | Self | super | crate | union
Path: Nm | :: Nm | Path :: Nm | Path :: Ta | Qp :: Nm
Qp: < Ty > | < Ty as Ty >
Ta: < Tas > | < Tas , > | < >
Tas: Targ | Tas , Targ
Targ: Ty | life | num | - num | BLK | id = Ty | id : Bds | id Ta = Ty | str
Tpath: Nm | Nm Ta | Tpath :: Nm | Tpath :: Nm Ta | :: Nm | Qp :: Nm | Tpath :: Ta | Nm TUP | Nm TUP -> Ty1 | Tpath :: Nm TUP | Tpath :: Nm TUP -> Ty1
Ty: Ty1 | Ty1 + Bds | dyn Bds | id Bds | ForL Bds
Ty1: Tpath | & life? mut? Ty1 | && life? mut? Ty1 | & life? dyn Bd | & life? mut dyn Bd | * const Ty1 | * mut Ty1 | TUP | SLC | ! | Fnp | Mac | dyn Bd | id Bd
Fnp: ForL? Fq* fn FPAR | ForL? Fq* fn FPAR -> Ty1
ForL: for < Tps >
Bds: Bd | Bds + Bd | Bds +
Bd: Tpath | life | ? Tpath | ForL Tpath | TUP | ~ const Tpath | Fnp | ForL? Fnp
Tps: Tp | Tps , Tp | Tps ,
Tp: Attr* life | Attr* life : Bds | Attr* id | Attr* id : Bds | Attr* id : Bds = Ty | Attr* id = Ty | const id : Ty | const id : Ty = X | id :
TP: < Tps > | < >
Pat: Pt0 | Pat bar Pt0 | bar Pt0
Pt0: mut? id | ref mut? id | mut? id @ Pt0 | ref mut? id @ Pt0 | & mut? Pt0 | && mut? Pt0 | Path | Path TPAT | Path SPAT | TPAT | LPAT | Lit | Lit ..= Lit | Lit .. Lit | Lit .. | .. | ..= Lit | .. Lit | Lit ... Lit | Mac | const BLK | self
Lit: num | - num | str | Path
Pats: Pat | Pats , Pat
Patl: Pats | Pats ,
Fpt: Attr* id : Pat | Attr* ref? mut? id | .. | num : Pat
Fpts: Fpt | Fpts , Fpt
Fptl: Fpts | Fpts ,
Attr: # TTB | # ! TTB
Let: Attr* let Pat ; | Attr* let Pat : Ty ; | Attr* let Pat = X ; | Attr* let Pat : Ty = X ; | Attr* let Pat = X else BLK ; | Attr* let Pat : Ty = X else BLK ;
S: Let | X ; | Attr* Blkx | Item | ; | Mac | Attr X ; | Attr+ Mac
Z: X
Vis: pub | pub TTP | crate
Fq: const | async | unsafe | extern str? | id
Fn: Fq* fn id TP? FPAR Rt? Wh? BLK | Fq* fn id TP? FPAR Rt? Wh? ;
Rt: -> Ty
Wh: where Wcs | where
Wcs: Wc | Wcs , Wc | Wcs ,
Wc: Ty : Bds | life : Bds | ForL Ty : Bds | Ty :
Item: Attr* Vis? It
It: Fn | struct id TP? Wh? FLD | struct id TP? TFLD Wh? ; | struct id ; | struct id TP Wh? ; | enum id TP? Wh? ENU | union id TP? Wh? FLD | Tr* trait id TP? Sup? Wh? ITEMS | Tr* impl TP? const? Ty Wh? ITEMS | Tr* impl TP? ! Ty for Ty Wh? ITEMS | Tr* impl TP? Ty for Ty Wh? ITEMS | mod id ITEMS | mod id ; | use Ut ; | const id : Ty = X ; | const id : Ty ; | static mut? id : Ty = X ; | static mut? id : Ty ; | type id TP? Sup? Wh? ; | type id TP? Sup? Wh? = Ty Wh? ; | extern crate Nm ; | extern crate Nm as id ; | unsafe? extern str? ITEMS | Mac ; | Mac | id TTP TTC | id id TTP TTC
Tr: unsafe | id | const
Sup: : Bds | :
Ut: Upath | Upath as id | Upath :: * | Upath :: UGRP | UGRP | :: UGRP | * | :: *
Upath: Nm | :: Nm | Upath :: Nm
Uts: Ut | Uts , Ut
Utl: Uts | Uts ,
T: Item | ; | Attr
I: Item | Attr
Fld: Attr* Vis? Nmf : Ty | Attr* Vis? Nmf : Ty = X
Nmf: id | union
Flds: Fld | Flds , Fld
Fldl: Flds | Flds ,
Tf: Attr* Vis? Ty
Tfs: Tf | Tfs , Tf
Tfl: Tfs | Tfs ,
En: Attr* Vis? id | Attr* id = X | Attr* id TFLD | Attr* id FLD | Attr* id TFLD = X | Attr* id FLD = X
Ens: En | Ens , En
Enl: Ens | Ens ,
Pr: Attr* Slf | Attr* Pat : Ty | Attr* Ty | ... | Attr* Pat : ... | Attr* mut? self : Ty
Slf: mut? self | & life? mut? self
Prs: Pr | Prs , Pr
Prl: Prs | Prs ,
As0: Av | As0 , Av
Av: X | Attr+ X
As: As0 | As0 ,
Ar: As | X ; X
Tys: Ty | Tys , Ty
Tyl: Tys | Tys ,
Sl: Ty | Ty ; X
Ma: Attr* Pat Gd? => X , | Attr* Pat Gd? => Blkx | Attr* Pat Gd? => X | Attr* Pat Gd? => Blkx ,
Gd: if Cnd
Mas: Ma | Mas Ma
Fv: Attr* id : X | id | .. X | num : X | .. | Attr+ id
Fvs: Fv | Fvs , Fv
Fvl: Fvs | Fvs ,
"""
_RUST_GROUPS = """
ARGS ( As? | EXP ( X | TUP ( Tyl? | FPAR ( Prl? | TPAT ( Patl? | TFLD ( Tfl? | TTP ( ATT*
IDX [ X | ARR [ Ar? | SLC [ Sl | LPAT [ Patl? | TTB [ ATT* | BLK { S; | SLIT { Fvl? | SPAT { Fptl? | FLD { Fldl? | ENU { Enl? | ITEMS { I; | UGRP { Utl? | MAT { Mas? | TTC { ATT*
"""
_SCALA = """
Cx: X
X: B | B : Ty | U Asg X | If | while EXP Nl? X | do X while EXP | for FORH yield? X | for ENUMS yield? X | try X Cat? Fin? | throw X | return X? | Lam | B match MAT | implicit Lam | B : Annot
Lam: Id => X | PARS => X | _ => X
Nl: NEVER
Asg: asg | =
If: if EXP X | if EXP X else X | if EXP X ; else X
Cat: catch MAT | catch X
Fin: finally X
B: U | B Op U | B Op
Op: bop | * | & | < | > | + | - | bar | Id | ** | : | <- | ! | ~ | ^ | ?
U: P | Uop P
Uop: ! | ~ | - | +
P: Id | num | str | sym | EXP | ARGS | P ARGS | P . Id | P TARG | P BLK | P CASES | BLK | CASES | new Tmp | this | super | super TARG | P . this | P . super | P . type | _ | P _ | null | . num | P . Id2 | P # Id
Id2: type
Id: id
Tmp: T1 ARGS* Withs? BLKC? | BLKC
Withs: With | Withs With
With: with T1
Ty: T0 | T0 => Ty | => Ty | TPAR => Ty | Ty Rb
Rb: NEVER
T0: T1 | T0 with T1 | T0 Id T1 | T0 BLKC | BLKC | T0 *
T1: Tn | Tn TARG | T1 # Id | TPAR | _ | _ Bd+ | T1 TARG | Annot T1
Tn: Id | Tn . Id | this . Id | Tn . type | this . type | Tn . this | super . Id
Bd: <: Ty | >: Ty | <% Ty | : Ty
Tys: Ty | Tys , Ty
Tpl: Tpp | Tpl , Tpp
Tpp: Annot* Var? Id TPS? Bd* | Annot* Var? _ Bd*
Var: + | -
Par: Annot* Pmod* Id : Ty | Annot* Pmod* Id : Ty = X
Pmod: val | var | implicit | private | protected | override | final | lazy | private TARG | protected TARG | sealed
Pars0: Par | Pars0 , Par
Pars: Pars0 | implicit Pars0 | LId
LId: LIt | LId , LIt
LIt: Id | _ | Id : Ty | _ : Ty | implicit Id
Annot: @ Tn | @ Tn ARGS | @ Tn TARG ARGS?
Mod: Annot | private | protected | override | final | sealed | abstract | implicit | lazy | private TARG | protected TARG | case
Pat: Pa | Pat bar Pa
Pa: Pb | Pa Id Pb | Pa bop Pb | Id : Ty0 | _ : Ty0 | Id @ Pa | _ * | Id @ _ *
Ty0: Tn | Tn TARG | _ | TPAR | Ty0 with Tn | BLKC
Pb: Id | num | - num | str | sym | _ | null | Tn PATS | Tn | PATS | this . Id | super . Id
Pats: Pat | Pats , Pat
Case: case Pat Gd? => Stm* | case Pat Gd? =>
Gd: if X
Stm: S
Cs: Case0
Case0: case Pat Gd? => | Case0 S | Case0 X
S: X ; | Def | ; | Case1 | import Imps ; | package Tn ; | package Tn BLKC | package object Id Ext? BLKC? | X
Case1: NEVER
Imps: Imp | Imps , Imp
Imp: Tn | Tn . _ | Tn . SEL | Tn . *
Sel: Si | Sel , Si
Si: Id | Id => Id | Id => _ | _
Def: Mod* val Pats0 = X ; | Mod* val Pats0 : Ty = X ; | Mod* val Ids : Ty ; | Mod* var Pats0 = X ; | Mod* var Pats0 : Ty = X ; | Mod* var Ids : Ty ; | Mod* var Ids : Ty = _ ; | Mod* def Dn TPS? PARS* = X ; | Mod* def Dn TPS? PARS* : Ty = X ; | Mod* def Dn TPS? PARS* : Ty ; | Mod* def Dn TPS? PARS* ; | Mod* def Dn TPS? PARS* BLK | Mod* type Id TPS? = Ty ; | Mod* type Id TPS? Bd* ; | Mod* class Id TPS? Mod* PARS* Ext? BLKC? | Mod* class Id TPS? Mod* PARS* Ext? ; | Mod* trait Id TPS? Ext? BLKC? | Mod* trait Id TPS? Ext? ; | Mod* object Id Ext? BLKC? | Mod* object Id Ext? ; | Mod* def this PARS+ = X ;
Dn: Id | bop | + | - | * | < | > | ! | & | Uop = | bar | ** | Id = | ~ | Uop : | / | ^ | ? | : Id
Ids: Id | Ids , Id
Pats0: Pat
Ext: extends Tmp0 | extends
Tmp0: T1 ARGS* Withs? | BLKC Withs?
For: Gen | For ; Gen | For ;
Gen: Pat <- X | val? Pat = X | Gen if X | if X | Pat = X
As0: Av | As0 , Av
Av: X | Id = X | X : _ *
Self: Id => | Id : Ty => | this : Ty => | _ : Ty =>
K: S | Self K | Self | Lam0 K
Lam0: Id => | PARS => | _ => | Id : Ty => | implicit Id =>
Kb: S | Lam0 Kb | Lam0
"""
_SCALA_GROUPS = """
ARGS ( As0? | EXP ( X | PARS ( Pars? | TPAR ( Tys? | PATS ( Pats? | FORH ( For | ENUMS { For
TARG [ Tys | TPS [ Tpl | BLK { Kb; | BLKC { K; | CASES { Wc; | MAT { Wc; | SEL { Sel
"""
_PY = """
V: Vi | Vi , | Vs | Vs ,
Vs: Vi , Vi | Vs , Vi
Vi: X | * X
X: C | C if C else X | lambda : X | lambda Lps : X
N: X | Id := X
C: U | C Bop U
Bop: bop | ** | + | - | * | & | < | > | / | in | is | and | or | is not | not in | @
U: P | Uop U
Uop: - | + | ~ | not | await
Id: id | match | case | type
P: Id | num | Strs | GEN | TUP | P ARGS | P SUB | P . Id | ARR | LGEN | DCT | None | True | False | ... | YLD | . num
Strs: str | Strs str
Sl: X | X? : X? | X? : X? : X? | : | * X | Id := X
Sls: Sl | Sls , Sl
Subs: Sls | Sls ,
Gen: N Comp
Comp: Cf | Comp Cf | Comp if C
Cf: for Ts in C | async for Ts in C
Tup: Ti | Ti , | Tups | Tups ,
Tups: Ti , Ti | Tups , Ti
Ti: N | * X
Pa: N | * X
Ka: Id = X | ** X
Pl: Pa | Pl , Pa
Kl: Ka | Kl , Ka | Kl , * X
As: Al | Al ,
Al: Pl | Kl | Pl , Kl | Gen
Tg: Id | P . Id | P SUB | TTUP | TARR
Ts: Tg | Tg , | * Tg | * Tg , | Tsl | Tsl ,
Ti2: Tg | * Tg
Tsl: Ti2 , Ti2 | Tsl , Ti2
Lp: Id | Id = X | * Id | ** Id | * | /
Lps0: Lp | Lps0 , Lp
Lps: Lps0 | Lps0 ,
Pm: Id Pt? | Id Pt? = X | * Id | * Id : X | * Id : * X | ** Id Pt? | * | /
Pt: : X
Pms: Pm | Pms , Pm
Ps: Pms | Pms ,
Ret: -> X
Nm: Id | Nm . Id
As1: Nm | Nm as Id
Nms: As1 | Nms , As1
Fi: Id | Id as Id
Fm: Fi | Fm , Fi
Fml: Fm | Fm ,
Dot: . | ... | Dot . | Dot ...
Fr: Nm | Dot | Dot Nm
Yl: yield | yield V | yield from X
Asg: = | Asg Ts = | Asg V0 =
V0: NEVER
Chain: Ts = | Chain Ts =
Ids: Id | Ids , Id
Sm: V | Chain V | Chain Yl | Tg asg V | Tg asg Yl | Tg : X | Tg : X = V | Tg : X = Yl | return | return V | pass | break | continue | import Nms | from Fr import Fm | from Fr import IMP | from Fr import * | raise | raise X | raise X from X | assert X | assert X , X | del Ts | global Ids | nonlocal Ids | Yl | type Id = X | type Id SUB = X
Sms: Sm | Sms ; Sm
Line: Sms | Sms ; | Hd : | Hd : Sms | Hd : Sms ; | @ N
Hd: if N | elif N | else | for Ts in V | async for Ts in V | while N | def Id Tp? PARS Ret? | async def Id Tp? PARS Ret? | class Id Tp? ARGS? | try | except | except V | except X as Id | except * X | except * X as Id | finally | with Ws | async with Ws | with WTUP | match V | case Cp | case Cp if N
Tp: SUB
Wi: X | X as Tg
Ws: Wi | Ws , Wi
Wl: Ws | Ws ,
Cp: Ca | Cl | Cl , | Ca , | Ca as Id
Cl: Ca , Ca | Cl , Ca
Ca: C | C as Id | * Id
Di: N : X | ** X
Dis: Di | Dis , Di
Dil: Dis | Dis , | Di Comp | Tup | Gen
TgL: Ts
"""
_PY_GROUPS = """
ARGS ( As? | TUP ( Tup? | GEN ( Gen | PARS ( Ps? | IMP ( Fml | YLD ( Yl | WTUP ( Wl | TTUP ( TgL
SUB [ Subs | ARR [ Tup? | LGEN [ Gen | TARR [ TgL | DCT { Dil?
"""
_RUBY = """
X: C | C ? X : X | not X | C rescue X
C: U | C Bop U | U Asg X | C .. | .. U
Asg: asg | =
Bop: bop | ** | bar | + | - | * | & | < | > | / | and | or | .. | ...
U: P | Uop U
Uop: ! | - | + | * | & | ~ | definedq
P: Id | num | Strs | sym | self | EXP | P ARGS | P IDX | P . Nm | P &. Nm | ARR | DCT | P :: Nm | :: Id | P BLKR | -> LPS? BLKR | -> BLKR | yield | yield ARGS | P . ARGS | -> LPS do
Id: id | require | require_relative | attr_reader | attr_accessor | attr_writer
Nm: Id | class | end | begin | self | then | in | if | next | yield | for | when | and | or | not | bop | + | - | * | < | > | case | do | def | module | until | while | unless | else | rescue | ensure | return | break | alias | undef | retry | redo
Strs: str | Strs str
A: X | Lbl X | Lbl | X => X | * X | & X | ** X | & | * | **
Lbl: Id : | str : | Kw :
Kw: if | unless | class | end | for | in | do | begin | def | when | then | while | case | module | self | and | or | not | next | return | yield | else
As0: A | As0 , A
As: As0 | As0 ,
Mod: if X | unless X | while X | until X | rescue X
Cmd: Id Cs | P . Nm Cs | P &. Nm Cs | yield Cs | P :: Nm Cs | definedq X
Cs: C0 | Cs , A
C0: Aa | Lbl X | Lbl
Aa: Ax | Ax Bop C | Ax ? X : X | Cmd | not X | Ax => X | & X | * X
Ax: Id | num | Strs | sym | self | Ax ARGS | Ax IDX | Ax . Nm | Ax &. Nm | ARR | DCT | Ax :: Nm | :: Id | Ax BLKR | -> LPS? BLKR | ! Ax | - num | -> BLKR | EXP | yield
Do: do Bar?
Bar: bar Bps bar | ||
Bps: Bp | Bps , Bp | Bps ; Id | Bps ,
Bp: Id | * Id | & Id | ** Id | Id = Ax | Lbl | Lbl Ax | LPS | *
Pm: Id | Id = X | * Id | & Id | ** Id | Lbl | Lbl X | * | & | ** | LPS | ...
Pms: Pm | Pms , Pm
Dn: Nm | Nm = | self . Nm | self . Nm = | ARR | ARR = | bop | ! | + | - | * | < | > | ** | & | bar | ~ | + @ | - @ | Id . Nm | ^ | /
St: X | Cmd | Mlhs = Rhs | U Asg Cmd | return | return Xs | break | break X | next | next X | redo | retry | alias Al Al | undef Al | return Cmd | St Mod | super | C and St | C or St | C Asg2 Cmd
Asg2: NEVER
Al: Nm | sym
Xs: A | Xs , A
Mi: U | * U
Mlhs: Mi , Mi | Mlhs , Mi | Mi , | * U
Rhs: Xs | Cmd
Op0: class | module | def
H: class Cp Sup? | class bop self | class << self | module Cp | def Dn PARS | def Dn | def Dn Pms | if X | if Cmd | unless X | unless Cmd | while X | until X | while X do | until X do | for Ids in X | for Ids in X do | begin | case | case X | X Do | Cmd Do | U Asg X Do | U Asg Cmd Do | U Asg if X | U Asg case X | U Asg begin | U Asg unless X | return X Do | U Asg case | return if X | return case X | -> LPS? Do | U Asg -> LPS? Do | return Cmd Do | BEGIN | Xs => X Do | U Asg while X
Cp: Id | Cp :: Id | :: Id
Sup: < X
Ids: Id | Ids , Id
K: else | elsif X | elsif X then | when Ws | when Ws then | rescue | rescue Ws | rescue Ws => U | rescue => U | ensure | in Pt | in Pt then | then | elsif Cmd | rescue then
Pt: A | Pt , A | Pt bar A | Pt if X
Ws: A | Ws , A
End: end | end . Nm | end . Nm Cs | end . Nm ARGS | end Mod | end . Nm Do | end &. Nm | end . Nm BLKR | end Bop X | end . Nm ARGS Do | End . Nm | End . Nm ARGS | End . Nm BLKR
Line: St | H | K | End
Da: A | Da , A
Dl: Da | Da ,
"""
_RUBY_GROUPS = """
ARGS ( As? | EXP ( St | PARS ( Pms? | LPS ( Bps?
IDX [ As? | ARR [ As? | DCT { Dl? | BLKR { RB;
"""
_CS = """
Cx: X
X: L1 | Lam | U Asg X | throw X | ref X
Asg: asg | = | > > = | > >=
L1: B | B ? X : X
B: U | B Bop U | B is Pat | B as Ty | B switch SWX | B with LST
Bop: bop | * | & | < | > | + | - | > > | .. | ?? | >=
U: P | Uop U | CAST U | await U | .. U | CAST Lam
Uop: ! | ~ | - | + | inc | & | * | ^
P: Id | num | str | EXP | TUP | P ARGS | P IDX | P . Nm | P ?. Nm | P ? IDX | P inc | P ! | P -> id | new Crea | Ty0 . Nm | typeof TYP | default | default TYP | checked EXP | unchecked EXP | this | base | Cn . Nm | Gn | Id :: Id | ARR | delegate PARS? BLK | . num | ATTR Lam
Gn: id Gen
Nm: Id | Id Gen
Id: id | get | set | init | add | remove | var | async | partial | where | when | record | yield | await | with | not | and | or
Crea: Cn ARGS LST? | Cn LST | Ty IDX LST? | Ty DIM LST | ARGS LST? | LST | DIM LST | Ty0 IDX DIM* LST? | Ty0 DIM+ LST | Cn IDX DIM* LST? | Cn DIM+ LST | ARGS | IDX LST
Lam: Lm* Id => Lb | Lm* LPAR => Lb
Lm: async | static
Lb: X | BLK
Ty: T0 Sfx*
Sfx: ? | DIM | *
T0: Ty0 | Cn | TTUP | ref T0 | ref readonly T0
Ty0: void
Cn: Id | Id Gen | Cn . Id | Cn . Id Gen | Id :: Id
Gen: < Gs > | < Commas? >
Commas: , | Commas ,
Gs: Ga | Gs , Ga
Ga: Ty | in Ty | out Ty | ATTR Ty
Pat: Ty | Ty Id | X | Rel | Pat Logic Pat | not Pat | PPAT Id? | Ty? SPAT Id? | Ty PPAT SPAT? Id? | LPAT | var Id
Logic: and | or
not: id
Rel: < B0 | > B0 | bop B0 | >= B0
B0: U
Arm: Pat => X | Pat when X => X
Arms: Arm | Arms , Arm
Arml: Arms | Arms ,
Mod: public | private | protected | internal | static | readonly | const | abstract | virtual | override | sealed | extern | unsafe | partial | async | new | id | ref
Pr: ATTR* Prm* Ty Id | ATTR* Prm* Ty Id = X | ATTR* Prm* Ty
Prm: ref | out | in | params | this | readonly
Prs: Pr | Prs , Pr
Lps: Id | Lps , Id | Prs
A: X | id : X | ref X | out X | out Ty Id | in X
As0: A | As0 , A
D: Id | Id = X | Id = LST | Id IDX
Ds: D | Ds , D
Lab: case Pat : | case Pat when X : | default :
W: S | Lab W | Lab
If: if EXP S | if EXP S else S
Cat: catch CATP? Whn? BLK
Whn: when EXP
Catp: Ty Id?
Fin: finally BLK
S: BLK | X ; | Lq* Ty Ds ; | If | while EXP S | do S while EXP ; | for FORH S | foreach FE S | await foreach FE S | switch EXP SWB | switch TUP SWB | try BLK Cat* Fin? | throw ; | return ; | return X ; | break ; | continue ; | goto id ; | goto case X ; | goto default ; | yield return X ; | yield break ; | using RES S | using Ty Ds ; | await using RES S | await using Ty Ds ; | lock EXP S | checked BLK | unchecked BLK | unsafe BLK | fixed RES S | id : S | Lf | ; | ATTR Lf
Lq: const | ref | readonly
Lf: Mod* Ty Id TP? PARS Wh* BLK | Mod* Ty Id TP? PARS Wh* => X ;
TP: < Tps >
Tps: Tp | Tps , Tp
Tp: ATTR* Vr? Id
Vr: in | out
Fi: Xs | Ty Ds
Xs: X | Xs , X
For: Fi? ; X? ; Xs?
Fe: Ty Id in X | Ty TTUP in X | var TUP in X | ref Ty Id in X
Res: X | Ty Ds
Wh: where Id : Cons
Cons: Con | Cons , Con
Con: Ty | class | class ? | struct | new ARGS | default
Bs: : Bl
Bl: Bi | Bl , Bi
Bi: Ty | Ty ARGS
Kind: class | struct | interface | record | record class | record struct
Cls: ATTR* Mod* Kind Id TP? PARS? Bs? Wh* CLS ;? | ATTR* Mod* Kind Id TP? PARS? Bs? Wh* ; | ATTR* Mod* enum Id Bs? ENU ;? | ATTR* Mod* delegate Ty Id TP? PARS Wh* ;
Ini: : this ARGS | : base ARGS
Body: BLK | => X ; | ;
Mn: Id | Cn . Id | Cn . this | this
M: ATTR* Mod* Ty Mn TP? PARS Wh* Body | ATTR* Mod* Id PARS Ini? Body | ATTR* Mod* ~ Id PARS Body | ATTR* Mod* Ty Ds ; | ATTR* Mod* event Ty Ds ; | ATTR* Mod* event Ty Mn ACC | ATTR* Mod* Ty Mn ACC | ATTR* Mod* Ty Mn ACC = X ; | ATTR* Mod* Ty Mn => X ; | ATTR* Mod* Ty Mn IPAR ACC | ATTR* Mod* Ty Mn IPAR => X ; | ATTR* Mod* Ty operator Op PARS Body | ATTR* Mod* Cnv operator Ty PARS Body | Cls | ;
Cnv: implicit | explicit
Op: bop | + | - | * | & | < | > | ! | ~ | inc | > > | id
Ac: ATTR* Mod* Acn Body
Acn: get | set | init | add | remove
T: using static? Cn ; | using Id = Ty ; | namespace Cn ; | namespace Cn NSP ;? | Cls | ATTR | ; | S | extern id id ; | id using Cn ;
En: ATTR* Id | ATTR* Id = X
Ens: En | Ens , En
Enl: Ens | Ens ,
Li: X | LST | Id = X | Id = LST | IDX = X | IDX = LST
Ls: Li | Ls , Li
L: Ls | Ls ,
Tt: Ty | Ty Id
Tts: Tt , Tt | Tts , Tt
Tups: A , A | Tups , A
Pts: Pat | Pts , Pat | Id : Pat
Sp: Id : Pat | Cn : Pat | Sp , Id : Pat | Sp ,
Sr: .. | X ..
Lpt: Pat | Lpt , Pat | .. | Lpt , ..
Ix: As0 | X .. X | .. X | X ..
El: As0 | .. X
"""
_CS_GROUPS = """
ARGS ( As0? | EXP ( X | PARS ( Prs? | LPAR ( Lps? | CAST ( Ty | TYP ( Ty | TUP ( Tups | TTUP ( Tts | FORH ( For | FE ( Fe | RES ( Res | CATP ( Catp | PPAT ( Pts?
IDX [ Ix | DIM [ Commas? | ATTR [ ATT* | IPAR [ Prs | ARR [ El? | LPAT [ Lpt? | BLK { S; | CLS { M; | LST { L? | ENU { Enl? | SWB { W; | SWX { Arml? | ACC { Ac; | NSP { T; | SPAT { Sp?
"""
TEXT = {
    "c": _C + "Ix: Cx\nDm: X | static X | * | Q X | Q* *\nTYA0: NEVER\n", "cpp": _CPP, "java": _JAVA, "csharp": _CS, "go": _GO + "Elp: ...\n",
    "javascript": _JS, "typescript": _JS + _TS_MORE, "php": _PHP, "rust": _RUST, "scala": _SCALA + "Wc: Case0 | Case0 ;\nTyX: Ty\n", "python": _PY, "ruby": _RUBY,
}
GROUPS = {
    "c": _C_GROUPS, "cpp": _CPP_GROUPS, "java": _JAVA_GROUPS, "csharp": _CS_GROUPS, "go": _GO_GROUPS, "javascript": _JS_GROUPS, "typescript": _TS_GROUPS,
    "php": _PHP_GROUPS, "rust": _RUST_GROUPS, "scala": _SCALA_GROUPS, "python": _PY_GROUPS, "ruby": _RUBY_GROUPS,
}
#: Languages that end statements at line ends (the last one before a closing brace, too).
ASI = frozenset(["javascript", "typescript", "scala"])


def groups_of(language: str) -> dict[str, list[tuple[str, str]]]:
    """Per opening bracket the (kind, content) pairs."""
    out: dict[str, list[tuple[str, str]]] = {"(": [], "[": [], "{": []}
    for line in filter(None, GROUPS[language].splitlines()):
        for entry in line.split(" | "):
            kind, opener, content = entry.split()
            out[opener].append((kind, content))
    return out

"""The rule catalogue: id, kind, severity, type and confidence of each rule, and the profiles.

Fixed values, in order of the ids. Severity: E error, W warning, H hint.
"""

from __future__ import annotations

from dataclasses import dataclass

CATALOGUE = """
SCA001 MemoryLeak E Bug High
SCA002 EmptyExcept W Smell High
SCA003 SQLInjection E Vuln Medium
SCA004 HardcodedSecret E Vuln Medium
SCA005 FormatMismatch E Bug High
SCA006 FileReadError E File High
SCA007 UnusedUses H Smell High
SCA008 NilDeref W Bug High
SCA009 MissingFinally W Smell High
SCA010 DivByZero W Bug High
SCA011 DeadCode W Smell High
SCA012 LongMethod H Smell Medium
SCA013 LongParamList H Smell Medium
SCA014 MagicNumber H Smell Medium
SCA015 DuplicateString H Dup Medium
SCA016 HardcodedPath W Hotspot Medium
SCA017 DebugOutput W Smell Medium
SCA018 DeepNesting H Smell Medium
SCA019 TodoComment H Smell Medium
SCA020 EmptyMethod H Smell High
SCA021 DuplicateBlock H Dup Medium
SCA022 CyclomaticComplexity H Smell Medium
SCA023 CustomRule W Smell High
SCA024 DfmDefaultName H Smell Medium
SCA025 DfmHardcodedCaption H Smell Medium
SCA026 DfmHardcodedDbCreds E Vuln High
SCA027 DfmDuplicateBinding W Bug High
SCA028 DfmDeadEvent E Bug High
SCA029 DfmOrphanHandler H Smell High
SCA030 DfmEmptyBoundEvent H Smell High
SCA031 DfmSchemaMismatch H Smell High
SCA032 DfmCircularDataSource E Bug High
SCA033 DfmSqlFromUserInput E Vuln High
SCA034 DfmRequiredFieldUnbound W Bug High
SCA035 DfmRequiredFieldNotVisible W Bug High
SCA036 DfmFieldTypeMismatch H Smell Medium
SCA037 DfmTabOrderConflict H Smell Medium
SCA038 DfmForbiddenClass H Smell Medium
SCA039 DfmDbInUiForm H Smell Medium
SCA040 DfmCrossFormCoupling W Bug Low
SCA041 DfmLayerViolation H Smell Medium
SCA042 DfmGodHandler H Smell Medium
SCA043 DfmActionMismatch W Bug High
SCA044 ConcatToFormat W Smell High
SCA045 WithStatement W Smell High
SCA046 ReversedForRange E Bug High
SCA047 SelfAssignment W Bug High
SCA048 VirtualCallInCtor E Bug High
SCA049 LengthUnderflow H Bug Low
SCA050 CanBeUnitPrivate H Smell Low
SCA051 CanBeProtected H Smell Low
SCA052 UnusedPublicMember H Smell Low
SCA053 UnusedLocalVar H Smell High
SCA054 UnusedParameter H Smell Medium
SCA055 TautologicalBoolExpr E Bug High
SCA056 DfmMasterDetailUnlinked E Bug High
SCA057 DfmDataModuleSplitHint H Smell High
SCA058 SqlDangerousStatement E Bug High
SCA059 FormatLocaleHint H Bug High
SCA060 GotoStatement W Smell High
SCA061 TabulationCharacter H Smell Low
SCA062 TooLongLine H Smell Low
SCA063 TrailingWhitespace H Smell Low
SCA064 LowercaseKeyword H Smell Low
SCA065 NoSonarMarker H Smell High
SCA066 EmptyArgumentList H Smell High
SCA067 InlineAssembly W Smell High
SCA068 TrailingCommaArgList H Smell High
SCA069 DigitGrouping H Smell Low
SCA070 CommentedOutCode H Smell Medium
SCA071 UnitLevelKeywordIndent H Smell High
SCA072 RedundantBoolean H Smell High
SCA073 EmptyInterface H Smell High
SCA074 AssertMessage H Smell High
SCA075 ExplicitTObjectInheritance H Smell High
SCA076 GroupedDeclaration H Smell Low
SCA077 EmptyBlock H Smell High
SCA078 ExceptOnException W Bug Low
SCA079 ConsecutiveSection H Smell Low
SCA080 RedundantJump H Smell High
SCA081 ClassPerFile H Smell High
SCA082 SuperfluousSemicolon H Smell High
SCA083 EmptyFinallyBlock W Bug High
SCA084 AssignedAndAssignedNil H Smell High
SCA085 FreeAndNilHint H Smell High
SCA086 AvoidOut H Smell High
SCA087 EmptyVisibilitySection H Smell High
SCA088 LegacyInitializationSection H Smell High
SCA089 PublicField H Smell High
SCA090 NestedTry H Smell High
SCA091 CaseStatementSize H Smell Medium
SCA092 EmptyFile H Smell High
SCA093 TwiceInheritedCalls W Bug High
SCA094 RedundantParentheses H Smell High
SCA095 ConsecutiveVisibility H Smell High
SCA096 ConstructorWithoutInherited W Bug High
SCA097 DestructorWithoutInherited E Bug High
SCA098 RedundantConditional H Smell High
SCA099 IfElseBegin H Smell High
SCA100 PointerName H Smell High
SCA101 BeginEndRequired H Smell High
SCA102 NestedRoutine H Smell High
SCA103 FieldName H Smell High
SCA104 TypeName H Smell High
SCA105 InterfaceName H Smell High
SCA106 MethodName H Smell High
SCA107 CanBeStrictPrivate H Smell Low
SCA108 SynchronizeInDestructor E Bug High
SCA109 LockWithoutTryFinally E Bug Medium
SCA110 StringConcatInLoop W Smell High
SCA111 ParamByNameInLoop H Smell High
SCA112 FieldByNameInLoop H Smell High
SCA113 ThreadResumeDeprecated W Smell High
SCA114 TThreadDestroyWithoutTerminate E Bug High
SCA115 HttpInsteadOfHttps W Hotspot High
SCA116 DisabledTlsVerification E Vuln High
SCA117 PublicMemberWithoutDoc H Smell Medium
SCA118 ExceptionName H Smell High
SCA119 LocalConstantName H Smell High
SCA120 MissingRaise E Bug High
SCA121 RoutineResultUnassigned E Bug Medium
SCA122 ReRaiseException W Bug High
SCA123 CastAndFree H Smell High
SCA124 InstanceInvokedConstructor W Bug High
SCA125 InheritedMethodEmpty H Smell High
SCA126 NilComparison H Smell High
SCA127 RaisingRawException W Smell High
SCA128 DateFormatSettings W Bug High
SCA129 UnicodeToAnsiCast W Bug High
SCA130 CharToCharPointerCast E Bug High
SCA131 IfThenShortCircuit W Bug High
SCA132 ExceptionTooGeneral W Smell High
SCA133 RaiseOutsideExcept E Bug High
SCA134 UseAfterFree E Bug Low
SCA135 AbstractNotImpl E Bug Low
SCA136 LeakInConstructor E Bug High
SCA137 IntegerOverflow E Bug High
SCA138 GodClass W Smell Medium
SCA139 FreeWithoutNil W Smell High
SCA140 MultipleExit W Smell Medium
SCA141 LargeClass W Smell Medium
SCA142 UnsortedUses H Smell Low
SCA143 MissingUnitHeader H Smell High
SCA144 FloatEquality W Bug High
SCA145 ExceptInDestructor W Bug High
SCA146 BooleanParam H Smell Medium
SCA147 UnusedPrivateMethod H Smell Medium
SCA148 CanBeClassMethod H Smell Low
SCA149 MissingOverride W Bug High
SCA150 BoolAlwaysTrue W Bug High
SCA151 ConstantReturn H Smell Medium
SCA152 HardcodedString H Smell Medium
SCA153 UnpairedLock W Bug High
SCA154 MoveSizeOfPointer W Bug High
SCA155 WithMultipleTargets H Smell High
SCA156 GetMemWithoutFreeMem W Bug High
SCA157 SetLengthAppendInLoop W Smell High
SCA158 PointerArithmeticOnString W Bug Low
SCA159 EmptyOnHandler W Bug High
SCA160 StringFromPointer W Bug High
SCA161 PointerSubtraction W Bug High
SCA162 InsecureCryptoAlgorithm W Vuln Medium
SCA163 CommandInjection E Vuln High
SCA164 UnusedRoutine H Smell High
SCA165 UnusedSuppression H Smell High
SCA166 UninitVar E Bug High
SCA167 InsecureRandom W Bug High
SCA168 DefaultCaseInCaseStatement H Smell High
SCA169 AssertWithSideEffect W Bug High
SCA170 ConstStringParameter H Smell Low
SCA171 CompilerDirectiveScope W Smell High
SCA172 BooleanPropertyNaming H Smell High
SCA173 VariantTypeMisuse H Smell High
SCA174 TObjectListWithoutOwnership W Bug High
SCA175 AnonMethodCaptureLoopVar E Bug High
SCA176 CognitiveComplexity W Smell High
SCA177 ThreadFreeOnTerminateWithRef E Bug High
SCA178 PathTraversal E Vuln High
SCA179 AttributeIgnoreWithoutReason H Smell High
SCA180 AttributeDuplicate W Smell High
SCA181 AttributeCategoryWithoutString E Bug High
SCA182 AttributeTestFixtureWithoutTests W Smell High
SCA183 AttributeMisalignment H Smell High
SCA184 DfmComponentUnused H Smell Low
SCA185 SourceUtf8NoBom W Bug Low
SCA186 SourceInvalidUtf8 E File High
SCA187 SourceControlChar E File High
SCA188 SourceBidiOverride E Vuln High
SCA189 SourceAnsiNonAscii W Smell Medium
SCA190 SourceUtf16 H Smell Low
SCA191 SourceUtf32 E File High
SCA192 SourceInvisibleChar W Vuln Medium
SCA193 SourceNonAsciiIdentifier W Vuln Medium
SCA194 NotIncludedInProject H Smell High
SCA195 UsedButNotInProject H Smell High
SCA196 ManagedResultUninit W Bug Medium
"""

SEVERITY = {"E": 0, "W": 1, "H": 2}
CONFIDENCE = {"Low": 0, "Medium": 1, "High": 2}
TYPES = {"Smell": "CodeSmell", "Bug": "Bug", "Vuln": "Vulnerability", "Hotspot": "SecurityHotspot", "File": "FileError", "Dup": "CodeDuplication"}
#: Minutes that a fix takes, by type.
EFFORT = {"Bug": 20, "Vulnerability": 30, "SecurityHotspot": 30, "CodeSmell": 10, "CodeDuplication": 15, "FileError": 20}


@dataclass(frozen=True)
class Rule:
    rule_id: str
    kind: str
    severity: int
    type: str
    confidence: int


RULES = {p[1]: Rule(p[0], p[1], SEVERITY[p[2]], TYPES[p[3]], CONFIDENCE[p[4]]) for p in (line.split() for line in CATALOGUE.strip().splitlines())}

#: The kinds of the profiles. strict has all kinds, default all but those of style.
PROFILES = {
    "style": "PublicMemberWithoutDoc NilComparison BeginEndRequired WithStatement ClassPerFile DfmHardcodedCaption IfElseBegin",
    "ide-fast": """MemoryLeak SQLInjection HardcodedSecret FormatMismatch NilDeref MissingFinally DivByZero DeadCode DebugOutput FileReadError DfmHardcodedDbCreds DfmDeadEvent DfmDuplicateBinding
        DfmSchemaMismatch DfmCircularDataSource DfmSqlFromUserInput DfmRequiredFieldUnbound DfmRequiredFieldNotVisible DfmCrossFormCoupling DfmActionMismatch""",
    "security": "SQLInjection HardcodedSecret HardcodedPath DfmHardcodedDbCreds DfmSqlFromUserInput",
    "bugs-only": """MemoryLeak FormatMismatch NilDeref DivByZero SQLInjection HardcodedSecret FileReadError DfmDuplicateBinding DfmDeadEvent DfmSchemaMismatch DfmCircularDataSource DfmRequiredFieldUnbound
        DfmRequiredFieldNotVisible DfmCrossFormCoupling DfmActionMismatch""",
    "code-quality": """EmptyExcept UnusedUses MissingFinally DeadCode LongMethod LongParamList MagicNumber DebugOutput DeepNesting TodoComment EmptyMethod CyclomaticComplexity DuplicateString DuplicateBlock
        DfmDefaultName DfmHardcodedCaption DfmOrphanHandler DfmEmptyBoundEvent DfmFieldTypeMismatch DfmTabOrderConflict DfmForbiddenClass DfmDbInUiForm DfmLayerViolation DfmGodHandler NotIncludedInProject UsedButNotInProject""",
    "dfm-only": """DfmDefaultName DfmHardcodedCaption DfmHardcodedDbCreds DfmDuplicateBinding DfmDeadEvent DfmOrphanHandler DfmEmptyBoundEvent DfmSchemaMismatch DfmCircularDataSource DfmSqlFromUserInput
        DfmRequiredFieldUnbound DfmRequiredFieldNotVisible DfmFieldTypeMismatch DfmTabOrderConflict DfmForbiddenClass DfmDbInUiForm DfmCrossFormCoupling DfmLayerViolation DfmGodHandler DfmActionMismatch""",
}


def profile(name: str) -> set[str]:
    """Kinds of a profile: strict, default, style, ide-fast, security, bugs-only, code-quality or dfm-only."""
    style = {*PROFILES["style"].split()}
    return {"strict": {*RULES}, "default": {*RULES} - style}.get(name) or {*PROFILES[name].split()}

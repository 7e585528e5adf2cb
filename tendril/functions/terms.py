"""The patterns, term lists and sentences of the rule classifiers, in their order."""

# Rubric tables.
RUBRIC_VOCABULARY = (
    "평가\\s*항목",
    "평가\\s*요소",
    "평가\\s*부문",
    "평가\\s*기준",
    "세부\\s*평가\\s*항목",
    "정성적?\\s*평가|정성평가",
    "정량적?\\s*평가|정량평가",
    "기술능력\\s*평가|기술\\s*평가",
    "가격\\s*평가",
    "협상\\s*적격",
)
RUBRIC_KEYWORD = "배점"
RUBRIC_POINTS = "\\d+(?:\\.\\d+)?\\s*점"
RUBRIC_TOTAL = "(?:합계|소계|총점|총계|총\\s*계)\\D{0,6}\\d"
RUBRIC_GRADES = "탁월|우수|보통|미흡|저조"
RUBRIC_LEVEL = "\\d\\s*등급"
RUBRIC_REQUIREMENTS = (
    "요구사항\\s*총괄표",
    "요구사항\\s*목록표",
    "고유\\s*번호",
    "\\b(?:MPR|PSR|PMR|QUR|SER|DAR|MHR|SFR|PFR|SIR|SUR|COR|TER)\\b",
)
RUBRIC_HEADER = "(?dm)^#{1,6}.*?(?:평가\\s*항목\\s*및\\s*배점|평가\\s*기준|평가\\s*배점|제안서?\\s*평가|기술능력\\s*평가|평가\\s*방법|세부\\s*평가\\s*항목|배점\\s*기준|평가\\s*점수)"

# Draft labels.
DRAFT_DIRECT = (
    "자연어처리",
    "자연어 처리",
    "rag",
    "retrieval augmented generation",
    "챗봇",
    "질의응답",
    "질의 응답",
    "생성형 ai",
    "생성 ai",
    "대규모 언어 모델",
    "llm",
    "민원 자동응답",
    "민원 상담",
    "에이전트 오케스트레이션",
    "도메인 특화 에이전트",
)
DRAFT_PROJECT = (
    "통합정보시스템",
    "통합 정보시스템",
    "공공 정보시스템",
    "공공행정",
    "공공 행정",
    "데이터 연계",
    "시스템 연계",
    "통합 대시보드",
    "fastapi",
    "postgresql",
    "pgvector",
    "python",
    "벡터 검색",
    "임베딩",
)
DRAFT_GENERIC = (
    "정보시스템",
    "시스템 구축",
    "시스템 고도화",
    "응용프로그램",
    "데이터베이스",
    "dbms",
    "api",
    "인터페이스",
    "대시보드",
    "웹 서비스",
    "통합검색",
    "데이터 플랫폼",
)
DRAFT_REASONS = (
    "회사 NLP/RAG 핵심역량과 프로젝트 수행근거가 함께 확인됨",
    "회사 NLP/RAG 핵심역량과 직접 연결되는 표현이 확인됨",
    "성공 프로젝트의 기술·기능 근거가 두 가지 이상 확인됨",
    "성공 프로젝트와 연결되는 구체 기술·기능이 확인됨",
    "일반적인 SI 수행역량만 부분적으로 관련됨",
    "회사 프로필·성공 프로젝트와 직접 연결되는 근거를 찾지 못함",
)

# Review priority.
PRIORITY_REASONS = ("관련도 2·3 초안", "검색 상위 10", "공고·청크 판정 충돌")
PRIORITY_UNSURE = "자동판정 불확실, 부분 관련 또는 검색 상위 30"
PRIORITY_SURE = "고신뢰 0점이며 검색 상위권 밖"

# Final labels.
FINAL_DIRECT = (
    "rag",
    "retrieval augmented generation",
    "llm",
    "생성형 ai",
    "생성형ai",
    "거대 언어 모델",
    "언어 모델",
    "언어모델",
    "질의응답",
    "대화형 질의",
    "대화형 인터페이스",
    "자연어 기반",
    "자연어 질의",
    "벡터 db",
    "vector db",
    "벡터 검색",
    "임베딩",
    "에이전트",
    "agent 기반",
    "ai agent",
    "mcp 기반",
    "지식 검색",
    "지식검색",
    "문서 검색",
    "문서 자동 생성",
    "자동 응답",
    "업무도우미",
)
FINAL_STRONG = (
    "통합정보시스템",
    "통합 정보시스템",
    "정보시스템 고도화",
    "공공 정보시스템",
    "데이터 통합",
    "통합 데이터",
    "데이터 연계",
    "연계 데이터",
    "시스템 연계",
    "api 연계",
    "데이터 파이프라인",
    "데이터 수집",
    "데이터 분석",
    "통합 분석",
    "대시보드",
    "자동화 보고서",
    "업무 자동화",
    "행정업무 자동화",
    "통합 관리 환경",
    "db 연계",
    "의사결정 지원",
)
FINAL_GENERIC = (
    "정보시스템",
    "시스템 구축",
    "시스템 개발",
    "기능 개선",
    "시스템 고도화",
    "응용프로그램",
    "데이터베이스",
    "dbms",
    "api",
    "웹 서비스",
    "ui/ux",
    "인터페이스",
    "데이터 표준화",
    "데이터 품질",
    "전자결재",
    "신용평가모형",
    "대안cb",
    "파생변수",
    "xai",
    "ai/ml",
    "ocr",
)
FINAL_PROCEDURAL = (
    "입찰 및 제안",
    "제안서 작성",
    "계약 일반",
    "산출물 관리",
    "교육지원",
    "교육 지원",
    "보고계획",
    "보고 계획",
    "하도급",
    "사업 추진일정",
    "사업 추진 일정",
    "작업장소",
    "작업 장소",
    "인력보안",
    "인력 보안",
    "저작권",
    "지식재산권",
    "납품",
    "검수",
    "계약 방법",
    "계약방법",
    "사업 기간",
    "사업기간",
    "사업 예산",
    "사업예산",
    "계약에 관한 법률",
    "조달공고",
    "사업자선정",
    "사업자 선정",
    "사업총괄 관리",
    "사업 관리 감독",
    "사업수행업체 업무 협조",
    "상기 일정",
)
FINAL_NON_MATCH = (
    "보안 요구사항",
    "보안요구사항",
    "테스트 요구사항",
    "테스트요구사항",
    "품질 요구사항",
    "품질요구사항",
    "성능 요구사항",
    "성능요구사항",
    "프로젝트 관리 요구사항",
    "프로젝트관리 요구사항",
    "프로젝트 지원 요구사항",
    "프로젝트지원 요구사항",
    "제약사항",
    "유지관리 요구사항",
    "유지관리요구사항",
    "ai 보안 관리 요구사항",
)
FINAL_AI_OPERATION = (
    "ai 서비스 운영",
    "ai 모니터링",
    "llmops",
    "ai 인프라",
    "gpu 클러스터",
    "학습데이터 관리",
    "rag데이터 품질",
    "rag 데이터 품질",
    "생성형 ai 솔루션 도입",
    "ai 서버 구성",
    "서버 요구사항",
    "로그 및 통계관리",
    "생성형 ai 서비스 관리 기능",
)
FINAL_LISTS = (
    "요구사항 개수",
    "요구 사항수",
    "요구사항 분류 건수",
    "시스템 장비구성 요구사항 ecr-",
    "분류기준(코드명)",
    "i. 사업개요",
    "ⅰ. 사업개요",
    "구분 고유번호 요구사항 명",
)
FINAL_INVENTORY = (
    "서버명 모델 네트워크 운영체계",
    "품목 모델명 제조사",
    "구분 수량 도입가",
    "순 번 구 분 사 양 설치년도",
    "정보화 현황 -",
    "서비스 구성도",
)
FINAL_SCOPE = (
    "추진과제 기능 요구사항",
    "추진 전략 추진 과제 추진 목표",
)
FINAL_FEATURE = (
    "모바일 기능",
    "푸시알림",
    "신청 기능",
    "조회 기능",
    "출력 기능",
    "메뉴 개발",
    "메뉴 생성",
    "사용자 인터페이스",
)
FINAL_ADJACENT = (
    "ai 인프라",
    "ai 모니터링",
    "ai 회의록 시스템",
    "ai 보안 관리 요구사항",
    "생성형 ai 솔루션 도입",
    "ai 서버 구성",
    "llmops",
    "학습데이터 관리 체계",
    "rag데이터 품질",
    "rag 데이터 품질",
    "csap 인증 공공 클라우드",
)
FINAL_INTEGRATION = (
    "정보 시스템 db 연동 요구",
    "시스템 인터페이스-공통 요구",
)
FINAL_TECHNICAL = (
    "기능요구사항",
    "기능 요구사항",
    "데이터요구사항",
    "데이터 요구사항",
    "인터페이스요구사항",
    "인터페이스 요구사항",
)
FINAL_DETAILS = ("세부 내용", "세부내용", "상세설명")
FINAL_REQUIREMENT = "요구사항"
FINAL_EXCLUDED = "연계 제외"
FINAL_EXCLUDED_PART = "연계"
FINAL_OVERVIEW = "개요"
FINAL_NAMES = ("사업명", "사 업 명")
# One for each rule, in the order of the rules.
FINAL_REASONS = (
    "공고 자체가 회사 역량·실적 범위와 관련 없음",
    "목차·분류표·이미지 등으로 독립적인 적합성 판단 근거가 부족함",
    "현행 장비·구성도 목록으로 구현 핵심 요구가 아님",
    "추진과제 요약표로 방향성만 확인 가능하고 상세 구현 근거는 부족함",
    "AI 운영·인프라·학습데이터·회의록 기능으로 핵심 RAG 응용과 인접함",
    "시스템·DB 연동 구현은 성공 프로젝트의 통합 경험을 전이할 수 있음",
    "AI 운영·인프라·관리 요구로 핵심 RAG 응용과 인접한 기술 적합",
    "AI 용어가 있으나 보안·품질·절차 조항이 중심임",
    "NLP·RAG·LLM·대화형 업무지원 역량과 직접 연결되는 핵심 내용",
    "일반 사업명만 제시되어 구체 구현 적합성 근거는 제한적임",
    "일반 보안·품질·성능·사업관리·계약 절차가 중심임",
    "일반 화면·모바일 기능의 부분 적합",
    "통합정보시스템·데이터 연계·대시보드 경험을 구체적으로 전이할 수 있음",
    "일반적인 SI 개발 역량과 부분적으로 연결되나 회사 고유 강점은 약함",
    "구체 기능·데이터·인터페이스 개발로 일반 SI 역량은 적용 가능함",
    "회사 역량·성공 프로젝트와 연결되는 구체 근거가 없음",
)
FINAL_NO_EVIDENCE = "본문 의미·역할"
FINAL_NOTE_START = "2차 전수검증 확정: "
FINAL_NOTE_EVIDENCE = "; 근거="

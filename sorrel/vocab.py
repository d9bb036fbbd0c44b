"""Closed vocabularies and tunables of review search.

Fixed values: the word lists below decide results, so they are stated in full and in the order that decides. There is a
table for each kind of term, as each is looked up for an output column of its own.
"""

from __future__ import annotations

OTHER = "기타"
ISSUE_CATEGORIES = ["배송/포장", "배터리/충전", "발열", "카메라", "성능/속도", "디자인/무게", "화면/디스플레이", "가격/가성비", "교환/반품/AS", OTHER]
SENTIMENTS = ["positive", "negative", "mixed", "neutral"]

#: Field weights of full-text search.
SEARCH_FIELDS = {"content": 3.0, "title": 2.0, "short_summary": 2.0, "aspect_keywords": 2.0, "product_name": 1.5, "item_name": 1.2}
ASPECT_FIELDS = {"content": 1.5, "title": 1.2, "short_summary": 1.5, "aspect_keywords": 2.5}
SENTIMENT_FIELDS = {"content": 1.0, "title": 1.0, "short_summary": 1.5}
PHRASE_FIELDS = {"content": 2.0, "title": 1.5, "short_summary": 2.0}

#: How many candidates each stage keeps, and the rank constant of reciprocal rank fusion.
LEXICAL_TOP, DENSE_TOP, FUSION_K, FUSION_TOP, FINAL_TOP = 100, 100, 60, 50, 10
BM25_K1, BM25_B = 1.2, 0.75
LEAST_LENGTH, LEAST_MEANINGFUL, DEDUPE_PREFIX = 10, 10, 200
VECTOR_SIZE = 768
#: Query vectors that are broadcast at a time: 4,096 of 768 numbers are 25 MB.
QUERY_BLOCK = 4096

#: A term found in a query brings its variants.
EXPANSIONS = {
    "뽁뽁이": ["뾱뾱이", "에어캡", "완충재", "완충 포장", "보호 포장"],
    "뾱뾱이": ["뽁뽁이", "에어캡", "완충재", "완충 포장"],
    "포장": ["패키징", "박스", "상자", "택배 포장", "완충"],
    "배송": ["택배", "로켓배송", "새벽배송", "도착"],
    "파손": ["찌그러짐", "찍힘", "구겨짐", "뜯김", "흠집"],
    "배터리": ["사용 시간", "방전", "오래감", "하루 종일"],
    "충전": ["충전속도", "고속충전", "완충", "C타입"],
    "카메라": ["사진", "셀카", "화질", "전면 카메라", "후면 카메라", "야간 촬영"],
    "성능": ["속도", "빠릿", "버벅", "렉", "부드러움"],
    "발열": ["뜨거움", "미지근", "열감", "발열관리"],
    "디자인": ["색상", "실물", "외관", "고급", "예쁨"],
    "무게": ["가벼움", "무거움", "그립감", "손목"],
    "화면": ["디스플레이", "주사율", "120Hz", "밝기", "AOD"],
    "가성비": ["가격", "저렴", "비싸", "혜택", "할인"],
    "교환": ["환불", "반품", "AS", "센터", "보증"],
    "반품": ["환불", "교환", "AS", "센터", "보증"],
    "만족": ["좋아요", "추천", "잘 왔", "문제없", "꼼꼼", "안전하게"],
    "불만": ["실망", "비추천", "문제", "후회", "아쉬움", "별로"],
}

#: Terms that stand for an aspect in an expanded query.
ASPECT_TERMS = {
    "배송/포장": ["배송", "포장", "뽁뽁이", "뾱뾱이", "에어캡", "완충", "완충재", "박스", "택배"],
    "배터리/충전": ["배터리", "충전", "사용 시간", "방전", "완충", "고속충전"],
    "발열": ["발열", "열감", "뜨거", "미지근"],
    "카메라": ["카메라", "사진", "셀카", "화질", "촬영", "전면", "후면", "야간"],
    "성능/속도": ["성능", "속도", "렉", "버벅", "빠릿", "스크롤", "부드러움"],
    "디자인/무게": ["디자인", "무게", "색상", "실물", "외관", "그립감", "가벼", "무거"],
    "화면/디스플레이": ["화면", "디스플레이", "주사율", "120Hz", "밝기", "AOD", "스크롤"],
    "가격/가성비": ["가격", "가성비", "저렴", "비싸", "혜택", "할인"],
    "교환/반품/AS": ["교환", "반품", "환불", "AS", "센터", "보증"],
}
POSITIVE_TERMS = {
    "배송/포장": ["만족", "좋", "꼼꼼", "안전", "잘 도착", "문제없", "튼튼", "감싸"],
    "배터리/충전": ["오래", "충분", "하루", "든든", "만족", "빠르"],
    "발열": ["없", "적", "괜찮", "관리", "만족"],
    "카메라": ["선명", "좋", "잘 나와", "밝", "만족", "예쁘"],
    "성능/속도": ["빠르", "부드럽", "쾌적", "만족", "렉없"],
    "디자인/무게": ["예쁘", "고급", "가볍", "편", "만족", "깔끔"],
    "화면/디스플레이": ["선명", "부드럽", "밝", "좋", "만족", "편"],
    "가격/가성비": ["좋", "저렴", "만족", "합리", "혜택"],
    "교환/반품/AS": ["빠르", "친절", "해결", "만족", "가능"],
}
NEGATIVE_TERMS = {
    "배송/포장": ["없이", "없", "파손", "찌그러", "구겨", "뜯겨", "불만", "실망", "반품"],
    "배터리/충전": ["짧", "빨리 닳", "방전", "느리", "아쉽", "불만"],
    "발열": ["심", "뜨겁", "불편", "문제", "아쉽"],
    "카메라": ["별로", "흐림", "실망", "안 좋", "아쉽"],
    "성능/속도": ["느리", "버벅", "렉", "끊", "불편"],
    "디자인/무게": ["무겁", "별로", "불편", "아쉽", "투박"],
    "화면/디스플레이": ["어둡", "끊", "불편", "별로", "아쉽"],
    "가격/가성비": ["비싸", "부담", "아쉽", "불만"],
    "교환/반품/AS": ["불편", "거절", "문제", "실패", "아쉽", "불만"],
}
POSITIVE_PHRASES = {
    "배송/포장": ["뽁뽁이로 잘", "뾱뾱이로 잘", "뽁뽁이 가득", "뾱뾱이 가득", "꼼꼼하게 포장", "포장 꼼꼼", "완충 포장", "안전하게 도착", "문제없이 도착", "잘 도착"],
    "배터리/충전": ["배터리 오래", "하루 종일", "충전 빠르", "충분히 사용"],
    "발열": ["발열 없", "발열 적", "뜨겁지 않", "미지근"],
    "카메라": ["사진 잘", "화질 좋", "셀카 잘", "선명하게", "카메라 만족"],
    "성능/속도": ["속도 빠르", "렉 없", "부드럽게", "성능 좋", "빠릿"],
    "디자인/무게": ["색상 예쁘", "실물 예쁘", "가벼워서", "그립감 좋", "디자인 만족"],
    "화면/디스플레이": ["화면 선명", "화면 부드럽", "밝기 좋", "눈이 편", "주사율 좋"],
    "가격/가성비": ["가성비 좋", "가격 좋", "저렴하게", "혜택 좋"],
    "교환/반품/AS": ["교환 빠르", "환불 처리", "AS 만족", "해결"],
}
NEGATIVE_PHRASES = {
    "배송/포장": ["뽁뽁이 없이", "뾱뾱이 없이", "포장 없이", "박스 파손", "박스 찌그러", "박스 구겨", "밀봉 뜯"],
    "배터리/충전": ["배터리 짧", "빨리 닳", "충전 느리", "금방 방전"],
    "발열": ["발열 심", "너무 뜨겁", "열감 심"],
    "카메라": ["카메라 별로", "화질 별로", "사진 흐", "카메라 실망"],
    "성능/속도": ["속도 느리", "버벅", "렉 걸", "끊김"],
    "디자인/무게": ["너무 무겁", "디자인 별로", "그립감 불편"],
    "화면/디스플레이": ["화면 어둡", "화면 끊", "디스플레이 별로"],
    "가격/가성비": ["가격 비싸", "가성비 별로", "너무 비싸"],
    "교환/반품/AS": ["교환 불가", "반품 불편", "환불 안", "AS 불만"],
}

#: Terms by which a query's aspect (the first that matches) and sentiment are told.
QUERY_ASPECTS = {
    "배송/포장": ["배송", "포장", "뽁뽁이", "뾱뾱이", "택배", "박스", "파손"],
    "배터리/충전": ["배터리", "충전", "사용 시간", "방전"],
    "발열": ["발열", "뜨거", "열감"],
    "카메라": ["카메라", "사진", "셀카", "화질", "촬영"],
    "성능/속도": ["성능", "속도", "렉", "버벅", "빠릿", "부드러"],
    "디자인/무게": ["디자인", "무게", "색상", "그립감", "가벼", "무거"],
    "화면/디스플레이": ["화면", "디스플레이", "주사율", "밝기", "AOD"],
    "가격/가성비": ["가격", "가성비", "저렴", "비싸", "할인"],
    "교환/반품/AS": ["교환", "반품", "환불", "AS", "센터", "보증"],
}
QUERY_POSITIVE = ["만족", "좋", "추천", "잘", "꼼꼼", "안전", "빠르"]
QUERY_NEGATIVE = ["불만", "실망", "비추천", "파손", "문제", "후회", "아쉽", "별로"]

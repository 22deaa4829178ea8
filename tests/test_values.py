from datetime import datetime
from decimal import Decimal

import pytest

from loomspark.functions import urls as U
from loomspark.functions import values as V

NOW = datetime(2026, 1, 15, 12)


@pytest.mark.parametrize("text,number,whole", [("1.299,00 €", 1299, 1299), ("$1,234.56", 1234.56, 1235), ("1,299", 1299, 1299), ("1.299", 1.299, 1299), ("12.5k", 12500, 12500), ("(1,200)", -1200, -1200), ("1.234.567", 1234567, 1234567), ("3,5 Mio", 3.5e6, 3500000), ("1,20,000", 120000, 120000), ("-5", -5, -5), ("none", None, None), ("", None, None), (None, None, None), ("２５", 25, 25)])
def test_numbers(text, number, whole):
    assert V.parse_number(text) == number and V.parse_integer(text) == whole


@pytest.mark.parametrize("text,want", [("$1,234.56", (Decimal("1234.56"), "USD")), ("EUR 45", (Decimal(45), "EUR")), ("from 20% off $30", (Decimal(30), "USD")), ("free", (Decimal(0), None)), ("12,99 zł", (Decimal("12.99"), "PLN")), ("no price", None), (None, None)])
def test_money(text, want):
    assert V.parse_money(text) == want


@pytest.mark.parametrize("text,want", [("2024-03-05T10:20:30Z", "2024-03-05T10:20:30+00:00"), ("05.03.2024", "2024-03-05T00:00:00"), ("03/05/2024", "2024-03-05T00:00:00"), ("25/12/2024", "2024-12-25T00:00:00"), ("March 5, 2024 3:30 pm", "2024-03-05T15:30:00"), ("5 mars 2024", "2024-03-05T00:00:00"), ("3 days ago", "2026-01-12T12:00:00"), ("gestern", "2026-01-14T00:00:00"), ("2024年3月5日", "2024-03-05T00:00:00"), ("Sep 2023", "2023-09-01T00:00:00"), ("1700000000", "2023-11-14T22:13:20+00:00"), ("2024-02-31", None), ("soon", None), (None, None)])
def test_dates(text, want):
    assert V.parse_datetime(text, NOW) == want


def test_dates_day_first():
    assert V.parse_date("03/05/2024", NOW, dayfirst=True) == "2024-05-03"


@pytest.mark.parametrize("text,want", [("PT1H30M", 5400), ("1h 30m", 5400), ("1:30:00", 5400), ("4:05", 245), ("P1DT2H", 93600), ("x", None), ("", None)])
def test_durations(text, want):
    assert V.parse_duration(text) == want


def test_quantities():
    assert V.parse_quantity("5 kg") == (Decimal(5), "kg") and V.parse_quantity("6'2\"") == (Decimal(74), "in")
    assert V.parse_quantity("5 in stock") is None
    assert V.convert(Decimal(1), "in", "cm") == Decimal("2.54") and V.convert(Decimal(0), "c", "f") == 32 and V.convert(Decimal(1), "kg", "m") is None


@pytest.mark.parametrize("f,text,want", [(V.normalize_email, "john [at] Example [dot] COM", "john@example.com"), (V.normalize_email, "a..b@x.com", None), (V.normalize_country, "Deutschland", "DE"), (V.normalize_language, "en_us", "en-US"), (V.normalize_language, "German", "de"), (V.normalize_availability, "Nicht verfügbar", "OutOfStock"), (V.normalize_availability, "https://schema.org/InStock", "InStock"), (V.parse_rating, "4.5 out of 5", 4.5), (V.parse_rating, "90%", 4.5), (V.parse_rating, "8", 4.0), (V.parse_coordinates, "52.52, 13.405", [52.52, 13.405]), (V.parse_coordinates, "0, 0", None), (V.clean_text, " a &amp;​ b ", "a & b"), (V.clean_text, " ", None), (V.fix_garbled, "fÃ¼r", "für"), (V.is_placeholder, "N/A", True), (V.is_placeholder, "{{ price }}", True), (V.is_placeholder, "0000-00-00", True), (V.is_placeholder, "Lorem ipsum dolor", True), (V.is_placeholder, "---", True), (V.is_placeholder, "no data", False), (V.is_placeholder, "", False), (V.normalize_availability, "Sold out", "SoldOut"), (V.normalize_availability, "out of stock", "OutOfStock"), (V.parse_boolean, "Ja", True), (V.parse_boolean, "2", None)])
def test_others(f, text, want):
    assert f(text) == want


def test_phones_and_addresses():
    assert V.normalize_phone("(415) 555-2671", "US") == "+14155552671" and V.normalize_phone("+49 (0)30 123456") == "+4930123456" and V.normalize_phone("123") is None
    a = V.parse_address("Hauptstr. 5, 10115 Berlin, Germany")
    assert (a["street"], a["city"], a["postal_code"], a["country"]) == ("Hauptstr. 5", "Berlin", "10115", "DE")
    assert V.parse_address("1600 Main St, Springfield, IL 62704, USA")["region"] == "US-IL"


@pytest.mark.parametrize("url,want", [("HTTP://Example.com:80/a/../b/?utm_source=x&b=2&a=1#frag", "http://example.com/b/?a=1&b=2"), ("https://x.example/%7euser/%c3%a9", "https://x.example/~user/%C3%A9"), ("https://x.example/#!/a", "https://x.example/#!/a"), ("https://x.example/a;jsessionid=1?sid=2", "https://x.example/a"), ("mailto:a@b.c", None), ("", None), (None, None), ("https://bücher.example/", "https://xn--bcher-kva.example/"), ("https://x.example/a/./b/../..", "https://x.example/")])
def test_urls(url, want):
    assert U.normalize_url(url) == want
    if want:
        assert U.normalize_url(want) == want


@pytest.mark.parametrize("url,want", [("https://shop.example/product/123?page=2&utm_source=x", "shop.example/product/{int}?page"), ("https://a.b/x/apple-iphone-15-pro/", "a.b/x/{slug}/"), ("https://a.b/2024-03-05/new-arrivals.html", "a.b/{date}/new-arrivals.html"), ("https://a.b/", "a.b/"), (None, None)])
def test_templates(url, want):
    assert U.url_template(url) == want


def test_refusals():
    assert U.refusal("ftp://a") == "scheme" and U.refusal("https://a.example/x.png") == "extension" and U.refusal("https://a.example/x", domains=("b.example",)) == "domain" and U.refusal("https://a.example/x") is None

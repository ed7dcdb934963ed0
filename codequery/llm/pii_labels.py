"""The labelled table of the field: lines written by hand, personal data in braces with its kind.

``TRAIN`` is learned from, ``HELD`` is what its accuracy is measured on. Numbers are made up, from ranges kept for
examples or from the card networks' test numbers. Lines without braces are near misses: dates, versions, sums, measures,
codes, scores and ids that look much like what is sought.
"""

from __future__ import annotations

TRAIN = """
Please write to {email:jane.doe@example.com} before Friday
contact: {email:j_smith99@mail.example.org}; office hours 9 to 5
<{email:info@example.co.uk}> wrote on 12 May 2019
E-mail {email:first.last+news@example.net}, fax on request
send it to {email:a.b@c.example} or {email:d-e@f.example}
reach us at {email:help_desk@support-site.example.com}.
host {ip:192.0.2.17} answered in 35 ms
from {ip:198.51.100.4} to {ip:203.0.113.250} port 8080
login failed for root from {ip:203.0.113.9}
({ip:10.0.0.1}) gateway, mask 24 bits
DNS servers are {ip:192.0.2.53}, {ip:192.0.2.54}
card {card:4111 1111 1111 1111} valid thru 09/27
pay with {card:5500-0000-0000-0004} today
Visa {card:4012888888881881} charged 25.00
number {card:3782 822463 10005} on the front
the old card {card:4222222222222} has 13 digits
account card {card:6011.0000.0000.0004} expires soon
use {card:3566 0020 2036 0505} for the test
{card:5555 5555 5555 4444} was declined twice
call {phone:+1 202 555 0143} after six
phone: {phone:(202) 555-0187}, ask for Ann
Tel. {phone:202-555-0119} or come by
my number is {phone:202.555.0164} call me
ring {phone:+44 20 7946 0958} in London
mobile {phone:07700 900123} only texts
office {phone:020 7946 0321} ext 12
Tel {phone:030 23125 456} Berlin
Telefon {phone:+49 30 23125 789}, Fax {phone:+49 30 23125 780}
appelez le {phone:01 99 00 12 34} le matin
tél. {phone:+33 1 99 00 56 78} ou écrivez
llame al {phone:+34 900 123 456} gratis
whatsapp {phone:+55 11 91234 5678} anytime
toll free {phone:1-800-555-0199} now
{phone:1 (800) 555-0155} is our hotline
contact {phone:0049 89 12345678} evenings
reach me on {phone:+61 491 570 156} please
home {phone:555-0142-778} or work
fax: {phone:(0)20/79460000}
call {phone:+12025550171} or write {email:me@example.com}
her cell {phone:2025550136} was off
ask {email:sales@example.com} or {phone:+1-202-555-0111} for a quote
the server {ip:198.51.100.77} mailed {email:root@host.example} twice
in 1999 and again in 2004 they met
on 2021-03-04 at 12:30:45 UTC
from 12/05/2019 to 31/12/2020 inclusive
version 2.4.11 of the tool, build 20190412
release 10.15.7.2048 is out
kernel 5.15.0 on arm64
section 4.2.1 and table 3.1
about 1,250,000 people and 3,400 cars
it costs $1,299.99 plus 19% tax
EUR 12.50 per kg, 3.5 kg each
order #4482913 shipped on Monday
invoice 2020-00017 over 340.00
ISBN 978-3-16-148410-0 in print
ISBN 0 306 40615 2 is older
part no. 44-1029-77A fits
SKU 889123 4410 in stock
id=5f3a9c0012bd77aa and hash 9e107d9d372bb6826bd81d3542a419d6
sha1 da39a3ee5e6b4b0d3255bfef95601890afd80709
uuid 123e4567-e89b-12d3-a456-426614174000
commit 4b825dc642cb6eb9a060e54bf8d69288fbee4904
lat 52.5200, lon 13.4050 north east
52.520008 13.404954 are the coordinates
ratio 16:9 at 1920x1080 and 60 Hz
temperatures of -3.5 to 21.75 degrees
chapter 12, pages 113-129, footnote 7
won 3-1, 6-4 and 7-6 (7-5)
score 21-19 21-17 in 43 minutes
room 204, floor 2, building 17
flight LH 1234 leaves at 7:05
train ICE 578 from track 9
zip 10115 or 90210-4411
1 2 3 4 5 6 7 8 9 10
0.5 1.0 1.5 2.0 2.5 3.0
3.14159265358979 is pi
1/2 cup of flour, 3/4 spoon of salt
call 911 or 112 in danger
channel 5 at 8 pm on 555
@someone wrote: see you @ 8
follow @news_desk and #day3
a@b is no address, nor is x @ y
cost centre 4711 0815 is closed
population: 83 149 300 in 2019
budget 1 200 000 000 for ten years
timestamp 1618884473 and 1618884473123
serial 000123456789000 on the back
tracking 1Z999AA10123456784 by post
IBAN DE89 3704 0044 0532 0130 00
account 0532013000 at bank code 37040044
tax id 12/345/67890 of the firm
reg. HRB 123456 at the court
matrix 1.0.0.1 is not 256.300.1.2
octets 300.1.2.3 are too large
10.1000/182 is a doi, so is 10.1038/nphys1170
arXiv:1706.03762 and 2005.14165
RFC 2616, 7230 to 7235
port 65535, id 65536
"""

HELD = """
mail {email:otto.mueller@firma.example} about it
cc {email:x.y-z@sub.mail.example.com}, thanks
node {ip:192.0.2.201} is down since 4 am
peers: {ip:198.51.100.10} {ip:198.51.100.11}
charge {card:4000 0566 5566 5556} once
{card:5105105105105100} and {card:6011-1111-1111-1117}
the amex {card:378282246310005} too
call {phone:(303) 555-0147} before noon
{phone:+43 1 2345678} is in Vienna
Handy {phone:0171 2345678} abends
text {phone:303-555-0100} now
numéro {phone:01 99 00 98 76} s'il vous plaît
ring {phone:+39 06 12345678} twice
{phone:+1 (303) 555-0172}, room 12
write {email:team@example.org} or call {phone:303.555.0129}
built in 1887, burnt in 1945, rebuilt 1952
due 2022-11-30, paid 2022-12-02
v1.22.3 came after v1.22.2
figure 7.3.2 shows 12 of 40 runs
$4,350,000 or 12.7% of all sales
order #99102 and invoice 2021-3381
ISBN 978-0-306-40615-7 second edition
key 3c59dc048e8850243be8079a5c74d079 found
position 48.8566, 2.3522 on the map
won 4-2 after 120 minutes
gate B 22, seat 14C, flight AF 1006
zip 75001 and 20095
take 2 1/2 cups and 3 eggs
1000 2000 3000 4000 feet
users 5 512 340 in 2018
epoch 1700000000 seconds
order 0012 3400 5600 closed
doi 10.1145/3292500.3330701
ports 8080, 8443 and 9000
"""

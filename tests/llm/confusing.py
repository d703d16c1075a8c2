"""Words that collide under every hash of the form sum of byte x power of an odd base, modulo 2^64."""

#: The parity of the bits set in each position, and its complement: 1,024 letters a and b each.
PAIR = tuple("".join("ab"[(i.bit_count() + k) % 2] for i in range(1024)) for k in (0, 1))

#: Pairs of words of one word_hashes: the second lane of eight bytes undoes the difference that the first one made.
ONE_HASH = (
    ('=kq=24leak4i84aa', '4htb67*5h[@[^@,6'),
    ('hq"q@^e4\'wezq,k6', 'al>bbq-,22g9,]p7'),
    ('hq"q@^e4m[_f~h=lmn', 'v[rqnxgx_d0d:@_|mn'),
    ('hq"q@^e4j.dye9]pabcdefgh~', '6l=5u,?0{#ed`c0iabcdefgh~'),
)

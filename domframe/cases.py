"""Authored pages and what must become of them, for the rules that generated pages don't touch."""

from __future__ import annotations

#: (page, what body holds) by group: a line for each node, divided by a broken bar, indented by blanks, attributes behind @.
BODIES = {
    "tables": [
        ('<table>a<tr><td>b</table>c', '"a"¦table¦ tbody¦  tr¦   td¦    "b"¦"c"'),
        ('<table><b>x<tr><td>y</table>', 'b¦ "x"¦table¦ tbody¦  tr¦   td¦    "y"'),
        ('<table><caption>a<col><tfoot><th>h', 'table¦ caption¦  "a"¦ colgroup¦  col¦ tfoot¦  tr¦   th¦    "h"'),
        ('<table><tr><td>1<tr><td>2<tbody><tr>', 'table¦ tbody¦  tr¦   td¦    "1"¦  tr¦   td¦    "2"¦ tbody¦  tr'),
        ('<table><tr><td><table><td>x</table>y', 'table¦ tbody¦  tr¦   td¦    table¦     tbody¦      tr¦       td¦        "x"¦    "y"'),
        ('<table><input type=hidden><input>', 'input¦table¦ input¦  @type="hidden"'),
        ('<table><form><tr></table>', 'table¦ form¦ tbody¦  tr'),
        ('<table> <tr> <td></table>', 'table¦ " "¦ tbody¦  tr¦   " "¦   td'),
        ('<table><colgroup> x', '"x"¦table¦ colgroup¦  " "'),
        ('<table><select><tr><td>a', 'select¦table¦ tbody¦  tr¦   td¦    "a"'),
        ('<table><td></tr></body></caption>x', '"x"¦table¦ tbody¦  tr¦   td'),
        ('<p><table>x', 'p¦ "x"¦ table'),
        ('<!doctype html><p><table>', 'p¦table'),
    ],
    "select": [
        ('<select><option>a<option>b<optgroup><option>c</select>d', 'select¦ option¦  "a"¦ option¦  "b"¦ optgroup¦  option¦   "c"¦"d"'),
        ('<select><div>x</div><b>y</select>z', 'select¦ div¦  "x"¦ b¦  "y"¦b¦ "z"'),
        ('<select><option>a<select>b', 'select¦ option¦  "a"¦"b"'),
        ('<select><option>a<input>', 'select¦ option¦  "a"¦input'),
        ('<select><button><selectedcontent></button><option>a<option selected>b', 'select¦ button¦  selectedcontent¦   "b"¦ option¦  "a"¦ option¦  @selected=""¦  "b"'),
    ],
    "foreign": [
        ('<svg viewbox=1 xlink:href=u><path/><foreignobject><p>x</p></foreignobject></svg>y', 'svg svg¦ @viewBox="1"¦ @xlink href="u"¦ svg path¦ svg foreignObject¦  p¦   "x"¦"y"'),
        ('<svg><foreignobject><p>x</foreignobject>y</svg>z', 'svg svg¦ svg foreignObject¦  p¦   "xy"¦"z"'),
        ('<svg><p>x', 'svg svg¦p¦ "x"'),
        ('<svg><font>a<font color=x>b', 'svg svg¦ svg font¦  "a"¦font¦ @color="x"¦ "b"'),
        ('<svg><![CDATA[a<b]]></svg><![CDATA[c]]>', 'svg svg¦ "a<b"¦<!-- [CDATA[c]] -->'),
        ('<svg><title><b>x</title></svg>', 'svg svg¦ svg title¦  b¦   "x"'),
        ('<math><mi><b>x</b></mi><mglyph/></math>', 'math math¦ math mi¦  b¦   "x"¦ math mglyph'),
        ('<math definitionurl=x><annotation-xml><svg><a/>', 'math math¦ @definitionURL="x"¦ math annotation-xml¦  svg svg¦   svg a'),
        ('<math><annotation-xml encoding=Text/HTML><div>x', 'math math¦ math annotation-xml¦  @encoding="Text/HTML"¦  div¦   "x"'),
    ],
    "formatting": [
        ('<a><p>x</a>y</p>', 'a¦p¦ a¦  "x"¦ "y"'),
        ('<b><i>1</b>2</i>', 'b¦ i¦  "1"¦i¦ "2"'),
        ('<p><b><i><u>a<p>b', 'p¦ b¦  i¦   u¦    "a"¦p¦ b¦  i¦   u¦    "b"'),
        ('<b><b><b><b>x<p>y', 'b¦ b¦  b¦   b¦    "x"¦    p¦     "y"'),
        ('<b>1<p>2</b>3</p>', 'b¦ "1"¦p¦ b¦  "2"¦ "3"'),
        ('<a>1<div>2<div>3</a>4</div>5</div>', 'a¦ "1"¦div¦ a¦  "2"¦ div¦  a¦   "3"¦  "4"¦ "5"'),
        ('<a>1<a>2', 'a¦ "1"¦a¦ "2"'),
        ('<nobr>1<nobr>2', 'nobr¦ "1"¦nobr¦ "2"'),
        ('<object><b>x</object>y', 'object¦ b¦  "x"¦"y"'),
        ('<marquee><p>x</marquee>y', 'marquee¦ p¦  "x"¦"y"'),
        ('<p><script/>x<b>y</script>z', 'p¦ script¦  "xy"¦ "z"'),
        ('<p><b><b><b><b>x<p>y', 'p¦ b¦  b¦   b¦    b¦     "x"¦p¦ b¦  b¦   b¦    "y"'),
        ('<p><b>x</p>y', 'p¦ b¦  "x"¦b¦ "y"'),
        ('<div><i>1<b>2</i>3</b></div>', 'div¦ i¦  "1"¦  b¦   "2"¦ b¦  "3"'),
    ],
    "blocks": [
        ('<p>One<p>Two', 'p¦ "One"¦p¦ "Two"'),
        ('<button>1<button>2', 'button¦ "1"¦button¦ "2"'),
        ('<h1>a<h2>b</h1>c', 'h1¦ "a"¦h2¦ "b"¦"c"'),
        ('<li>1<li>2<ul><li>3</ul>', 'li¦ "1"¦li¦ "2"¦ ul¦  li¦   "3"'),
        ('<dl><dt>a<dd>b<dt>c</dl>', 'dl¦ dt¦  "a"¦ dd¦  "b"¦ dt¦  "c"'),
        ('</p>x</br></p>', '"x"¦br¦p'),
        ('<pre>\na</pre><textarea>\nb</textarea><listing>\nc', 'pre¦ "a"¦textarea¦ "b"¦listing¦ "c"'),
        ('<form><form>x</form>y</form>z', 'form¦ "x"¦"yz"'),
        ('<image src=x>', 'img¦ @src="x"'),
        ('<ruby>a<rt>b<rp>c</ruby>', 'ruby¦ "a"¦ rt¦  "b"¦ rp¦  "c"'),
        ('a</body>b<!-- c -->', '"ab"¦<!--  c  -->'),
        ('<iframe><p></iframe><noembed><b></noembed><xmp><i></xmp>', 'iframe¦ "<p>"¦noembed¦ "<b>"¦xmp¦ "<i>"'),
        ('<plaintext></p>', 'plaintext¦ "</p>"'),
    ],
}
#: (page, the dump of its tree) by group.
DOCUMENTS = {
    "documents": [
        ('', '| <html>\n|   <head>\n|   <body>'),
        ("<!-- a --><!DOCTYPE html PUBLIC 'p' 's'>", '| <!DOCTYPE html "p" "s">\n| <!--  a  -->\n| <html>\n|   <head>\n|   <body>'),
        ('<html a=1><head><meta x></head> <body b=2>y</html><!-- e -->', '| <html>\n|   a="1"\n|   <head>\n|     <meta>\n|       x=""\n|   " "\n|   <body>\n|     b="2"\n|     "y"\n| <!--  e  -->'),
        ('<title>a<b></title><p>x<base>', '| <html>\n|   <head>\n|     <title>\n|       "a<b>"\n|   <body>\n|     <p>\n|       "x"\n|       <base>'),
        ('</head><link>', '| <html>\n|   <head>\n|     <link>\n|   <body>'),
        ('<noscript><p>x</noscript>', '| <html>\n|   <head>\n|     <noscript>\n|       "<p>x"\n|   <body>'),
        ('<body a=1><body a=2 b=3>x', '| <html>\n|   <head>\n|   <body>\n|     a="1"\n|     b="3"\n|     "x"'),
        ('</body></html>x<!--c-->', '| <html>\n|   <head>\n|   <body>\n|     "x"\n|     <!-- c -->'),
        ('<p>a</body> </html> ', '| <html>\n|   <head>\n|   <body>\n|     <p>\n|       "a  "'),
    ],
    "templates": [
        ('<template><tr><td>z</template>', '| <html>\n|   <head>\n|     <template>\n|       content\n|         <tr>\n|           <td>\n|             "z"\n|   <body>'),
        ('<body><template><p>a</template>b', '| <html>\n|   <head>\n|   <body>\n|     <template>\n|       content\n|         <p>\n|           "a"\n|     "b"'),
    ],
    "framesets": [
        ('<frameset><frame><frameset></frameset> x</frameset><noframes>y</noframes></html><!--c-->', '| <html>\n|   <head>\n|   <frameset>\n|     <frame>\n|     <frameset>\n|     " "\n|   <noframes>\n|     "y"\n| <!-- c -->'),
        ('<p><frameset>', '| <html>\n|   <head>\n|   <frameset>'),
        ('x<frameset>', '| <html>\n|   <head>\n|   <body>\n|     "x"'),
    ],
}
#: (page, element it is a fragment in, dump).
FRAGMENTS = [
    ('<li>a<li>b', 'ul', '| <li>\n|   "a"\n| <li>\n|   "b"'),
    ('<td>x', 'tr', '| <td>\n|   "x"'),
    ('<td>x', 'div', '| "x"'),
    ('<tr><td>x', 'table', '| <tbody>\n|   <tr>\n|     <td>\n|       "x"'),
    ('<option>a<option>b', 'select', '| <option>\n|   "a"\n| <option>\n|   "b"'),
    ('<b>x</b>', 'title', '| "<b>x</b>"'),
    ('<b>x', 'style', '| "<b>x"'),
    ('<path/><p>x', 'svg path', '| <svg path>\n| <p>\n|   "x"'),
    ('<mi>x', 'math math', '| <math mi>\n|   "x"'),
    ('<p>x', 'template', '| <p>\n|   "x"'),
    ('<p>x', 'html', '| <head>\n| <body>\n|   <p>\n|     "x"'),
    ('<col>', 'colgroup', '| <col>'),
    ('', 'div', ''),
    ('</svg><a/>', 'svg svg', '| <svg a>'),
]
#: (page, tokens): doctype (name, public, system, force quirks), start (name, attributes, self-closing), end, comment, chars.
TOKENS = [
    ('<p>Hello</p>', [('start', 'p', {}, False), ('chars', 'Hello'), ('end', 'p')]),
    ('<!DOCTYPE html>', [('doctype', 'html', None, None, False)]),
    ('<!doctype HTML PUBLIC \'-//x\' "sys">', [('doctype', 'html', '-//x', 'sys', False)]),
    ("<!DOCTYPE html SYSTEM 'about:legacy-compat'>", [('doctype', 'html', None, 'about:legacy-compat', False)]),
    ('<!DOCTYPE>', [('doctype', None, None, None, True)]),
    ('<!DOCTYPE html PUBLIC>x', [('doctype', 'html', None, None, True), ('chars', 'x')]),
    ("<!DOCTYPE html PUBLIC 'a>x", [('doctype', 'html', 'a', None, True), ('chars', 'x')]),
    ('<!DOCTYPE html bogus>', [('doctype', 'html', None, None, True)]),
    ('<!DOCTYPE html', [('doctype', 'html', None, None, True)]),
    ('<div class="foo" id=bar>', [('start', 'div', {'class': 'foo', 'id': 'bar'}, False)]),
    ("<a href='x'disabled A=1 a=2>", [('start', 'a', {'href': 'x', 'disabled': '', 'a': '1'}, False)]),
    ('<br/><br / x>', [('start', 'br', {}, True), ('start', 'br', {'x': ''}, False)]),
    ('<a =b=c d=>', [('start', 'a', {'=b': 'c', 'd': ''}, False)]),
    ('<DIV A=B>', [('start', 'div', {'a': 'B'}, False)]),
    ("<a\x00b c\x00='\x00'>", [('start', 'a�b', {'c�': '�'}, False)]),
    ('x<p', [('chars', 'x')]),
    ("<p a='", []),
    ('</p', []),
    ('<', [('chars', '<')]),
    ('</', [('chars', '</')]),
    ('</>x', [('chars', 'x')]),
    ('a < b', [('chars', 'a < b')]),
    ('</ x>', [('comment', ' x')]),
    ('<?php ?>', [('comment', '?php ?')]),
    ('<!x>', [('comment', 'x')]),
    ('<![CDATA[x]]>', [('comment', '[CDATA[x]]')]),
    ('<!-- hello -->', [('comment', ' hello ')]),
    ('<!-->x', [('comment', ''), ('chars', 'x')]),
    ('<!--->x', [('comment', ''), ('chars', 'x')]),
    ('<!---->', [('comment', '')]),
    ('<!--a--!>b', [('comment', 'a'), ('chars', 'b')]),
    ('<!--a--!b-->', [('comment', 'a--!b')]),
    ('<!--a--->', [('comment', 'a-')]),
    ('<!-- <!-- x -->', [('comment', ' <!-- x ')]),
    ('<!--a-', [('comment', 'a')]),
    ('<!--a--', [('comment', 'a')]),
    ('<!--a--!', [('comment', 'a')]),
    ('<!--a', [('comment', 'a')]),
    ('<!--\x00-->', [('comment', '�')]),
    ('a\r\nb\rc', [('chars', 'a\nb\nc')]),
    ('\x00', [('chars', '\x00')]),
    ('<title>&lt;<b>&#65;</TITLE >x', [('start', 'title', {}, False), ('chars', '<<b>A'), ('end', 'title'), ('chars', 'x')]),
    ('<style>&lt;</b></styles></style>', [('start', 'style', {}, False), ('chars', '&lt;</b></styles>'), ('end', 'style')]),
    ('<script>a<!--<script>b</script>c--></script>d', [('start', 'script', {}, False), ('chars', 'a<!--<script>b</script>c-->'), ('end', 'script'), ('chars', 'd')]),
    ('<script><!--></script>x', [('start', 'script', {}, False), ('chars', '<!-->'), ('end', 'script'), ('chars', 'x')]),
    ('<script><!--<script></script>', [('start', 'script', {}, False), ('chars', '<!--<script></script>')]),
    ('<script></scripty></script\t>', [('start', 'script', {}, False), ('chars', '</scripty>'), ('end', 'script')]),
    ('<plaintext></plaintext>&amp;', [('start', 'plaintext', {}, False), ('chars', '</plaintext>&amp;')]),
    ('<textarea><p></textarea>', [('start', 'textarea', {}, False), ('chars', '<p>'), ('end', 'textarea')]),
    ('<script/>x<b>', [('start', 'script', {}, True), ('chars', 'x'), ('start', 'b', {}, False)]),
    ('<script><!-x</script>y', [('start', 'script', {}, False), ('chars', '<!-x'), ('end', 'script'), ('chars', 'y')]),
    ('<script><!--a-b--c--d</script>e', [('start', 'script', {}, False), ('chars', '<!--a-b--c--d'), ('end', 'script'), ('chars', 'e')]),
    ('<script><!--<x></script>', [('start', 'script', {}, False), ('chars', '<!--<x>'), ('end', 'script')]),
    ('<script><!--</scriptx></script>', [('start', 'script', {}, False), ('chars', '<!--</scriptx>'), ('end', 'script')]),
    ('<script><!--<scriptx></script>z', [('start', 'script', {}, False), ('chars', '<!--<scriptx>'), ('end', 'script'), ('chars', 'z')]),
    ('<script><!--<script></script>--></script>q', [('start', 'script', {}, False), ('chars', '<!--<script></script>-->'), ('end', 'script'), ('chars', 'q')]),
    ('<script><!--<script>-x--y--></script>w', [('start', 'script', {}, False), ('chars', '<!--<script>-x--y-->'), ('end', 'script'), ('chars', 'w')]),
    ('<script><!--<script></scripty></script></script>', [('start', 'script', {}, False), ('chars', '<!--<script></scripty></script>'), ('end', 'script')]),
    ('<script><!--<script><</script></script>', [('start', 'script', {}, False), ('chars', '<!--<script><</script>'), ('end', 'script')]),
    ('<script><!--->a</script>', [('start', 'script', {}, False), ('chars', '<!--->a'), ('end', 'script')]),
    ('<script></</script>', [('start', 'script', {}, False), ('chars', '</'), ('end', 'script')]),
    ('<!DOCTYPE html PUBLIC"p""s">', [('doctype', 'html', 'p', 's', False)]),
    ("<!DOCTYPE html PUBLIC 'p' 's' x>", [('doctype', 'html', 'p', 's', False)]),
    ("<!DOCTYPE html PUBLIC 'p' x>", [('doctype', 'html', 'p', None, True)]),
    ("<!DOCTYPE html PUBLIC 'p'>", [('doctype', 'html', 'p', None, False)]),
    ('<!DOCTYPE html PUBLIC p>', [('doctype', 'html', None, None, True)]),
    ('<!DOCTYPE html SYSTEM>', [('doctype', 'html', None, None, True)]),
    ('<!DOCTYPE html SYSTEM x>', [('doctype', 'html', None, None, True)]),
    ("<!DOCTYPE html SYSTEM 's", [('doctype', 'html', None, 's', True)]),
    ('<!DOCTYPE html SYSTEM"s">', [('doctype', 'html', None, 's', False)]),
    ("<!DOCTYPE html SYSTEM 's>x", [('doctype', 'html', None, 's', True), ('chars', 'x')]),
    ('<!DOCTYPE html PUBLIC "p"', [('doctype', 'html', 'p', None, True)]),
    ("<!DOCTYPE html PUBLIC '' ''>", [('doctype', 'html', '', '', False)]),
    ('<!DOCTYPE\t HtMl  >', [('doctype', 'html', None, None, False)]),
    ('<!DOCTYPEhtml>', [('doctype', 'html', None, None, False)]),
    ('<!DOCTYPE a\x00b>', [('doctype', 'a�b', None, None, False)]),
    ('<a b = \'c\' d="e">', [('start', 'a', {'b': 'c', 'd': 'e'}, False)]),
    ("<a b='&amp;&lt' c=&copy;>", [('start', 'a', {'b': '&<', 'c': '©'}, False)]),
    ('<a/b>', [('start', 'a', {'b': ''}, False)]),
    ('</a b=c/>', [('end', 'a')]),
    ('<!-- <! -->a', [('comment', ' <! '), ('chars', 'a')]),
    ('<!--<!-->a', [('comment', '<!'), ('chars', 'a')]),
    ('<!--<!--->a', [('comment', '<!-'), ('chars', 'a')]),
    ('&#65;&#x42;&#0;&#x80;&amp;c', [('chars', 'AB�€&c')]),
]
#: (initial state, text, tokens) where the last start tag was title.
STATES = [
    ('rcdata', '&amp;</b></title>', [('chars', '&</b>'), ('end', 'title')]),
    ('rawtext', '&amp;\x00</title>', [('chars', '&amp;�'), ('end', 'title')]),
    ('plaintext', '</title>\x00', [('chars', '</title>�')]),
    ('cdata_section', 'a]]>b\x00', [('chars', 'ab\x00')]),
    ('script_data', '<!-- </title>', [('chars', '<!-- </title>')]),
    ('rcdata', '<</</tit></title/>x', [('chars', '<</</tit>'), ('end', 'title'), ('chars', 'x')]),
    ('rawtext', '</titlex></title >&lt;', [('chars', '</titlex>'), ('end', 'title'), ('chars', '<')]),
    ('cdata_section', 'a]]b]]]>c', [('chars', 'a]]b]c')]),
]
#: (text, decoded) in text, and in attribute values.
REFERENCES = [
    ('&amp;&lt;&copy;', '&<©'),
    ('&amp', '&'),
    ('&notit;', '¬it;'),
    ('&notin;', '∉'),
    ('&nosuch;', '&nosuch;'),
    ('& &&x;', '& &&x;'),
    ('&#65;&#x41;&#X41', 'AAA'),
    ('&#0;&#xD800;&#x110000;&#99999999999;', '����'),
    ('&#x80;&#150;&#x81;', '€–\x81'),
    ('&#;&#x;&#xg', '&#;&#x;&#xg'),
    ('&NotEqualTilde;', '≂̸'),
]
ATTRIBUTE_REFERENCES = [
    ('&not=x', '&not=x'),
    ('&notit;', '&notit;'),
    ('&not', '¬'),
    ('&not;=', '¬='),
    ('&copy&copy', '©©'),
    ('?a=b&lang=c&copy_x', '?a=b&lang=c©_x'),
    ('&amp;x', '&x'),
]
#: (page, selector, (tag, text) of each result in order).
SELECTORS = [
    ('<div><p>Hello</p><p>World</p></div>', 'p', [('p', 'Hello'), ('p', 'World')]),
    ("<div><p class='intro x'>a</p><p class=introx>b</p></div>", '.intro', [('p', 'a')]),
    ("<p class='a\n b\tc'>x</p>", '.a.b.c', [('p', 'x')]),
    ("<p id=q>x</p><p id='q r'>y", '#q', [('p', 'x')]),
    ('<p class=intro id=g>a<p class=intro>b', 'p.intro#g', [('p', 'a')]),
    ('<a href=/x>L</a><a name=y>M</a><a href>N', '[href]', [('a', 'L'), ('a', 'N')]),
    ('<input type=text><input type=password>', '[type=text]', [('input', '')]),
    ("<a href='https://a'>S</a><a href='http://b'>I</a>", '[href^=https]', [('a', 'S')]),
    ("<a href='d.pdf'>P</a><a href='d.txt'>T</a>", "[href$='.pdf']", [('a', 'P')]),
    ("<a href='/ex/1'>E</a><a href='/y'>T</a>", "a[href*='ex/']", [('a', 'E')]),
    ('<a href=x>E</a><a>T</a>', "[href^='']", [('a', 'E')]),
    ('<div><p>P</p><span>S</span><a>A</a></div>', 'a, p', [('a', 'A'), ('p', 'P')]),
    ('<div><p>P', 'p,', [('p', 'P')]),
    ('<div><p>P', '', []),
    ('<ul><li>A<li>A<li>B</ul>', 'li', [('li', 'A'), ('li', 'B')]),
    ('<div><p>D</p><span><p>N</p></span></div>', 'div > p', [('p', 'D')]),
    ('<div><div><p>x</p></div><p>y</p></div>', 'div > p', [('p', 'y'), ('p', 'x')]),
    ('<div><div><p>x</p></div><p>y</p></div>', 'div p', [('p', 'x'), ('p', 'y')]),
    ('<h1>t</h1>text<!--c--><p>a</p><p>b</p>', 'h1 + p', [('p', 'a')]),
    ('<h1>t</h1><p>a</p><div>d</div><p>b</p>', 'h1 ~ p', [('p', 'a'), ('p', 'b')]),
    ('<nav><ul><li><a href=/>x</a></ul></nav>', 'nav  ul>li   a[href]', [('a', 'x')]),
    ('<p>x</p>', 'body >', [('p', 'x')]),
    ('<p>x</p>', '> p', [('p', 'x')]),
    ('<div><b><i>x</i></b></div>', 'div > > i', [('i', 'x')]),
    ('<p>x</p><template><p>y</p></template>', 'p', [('p', 'x')]),
    ('<p>x</p>', 'P', []),
    ('<svg><a>x</a></svg><a>y</a>', 'a', [('a', 'x'), ('a', 'y')]),
    ('<i>1</i><b>2</b><div><i>1</i><u>3</u></div>', 'div > i + *', [('b', '2')]),
]
#: (fragment in a div, options of to_html, html).
FORMS = [
    ('<p>a<span>b</span>c</p>', {}, '<p>a<span>b</span>c</p>'),
    ('<br><img src=a.png>', {}, '<br><img src=a.png>'),
    ('<br>', {'use_trailing_solidus': True}, '<br />'),
    ("<p title='foo bar'></p>", {}, '<p title="foo bar"></p>'),
    ('<p title="it\'s x"></p>', {}, '<p title="it\'s x"></p>'),
    ('<p title=\'a "q"\'></p>', {}, '<p title=\'a "q"\'></p>'),
    ("<p title='a&b'></p>", {}, '<p title=a&b></p>'),
    ("<p title='a & b'></p>", {}, '<p title="a &amp; b"></p>'),
    ('<p title=\'"&#39; x\'></p>', {}, '<p title="&quot;\' x"></p>'),
    ("<input checked value=''>", {}, '<input checked value>'),
    ('<input checked=checked>', {}, '<input checked>'),
    ("<input checked value=''>", {'minimize_boolean_attributes': False}, '<input checked="" value="">'),
    ('<p a=b></p>', {'quote_char': "'"}, "<p a='b'></p>"),
    ('<p a=b></p>', {'quote_char': '"'}, '<p a="b"></p>'),
    ("<p a='x <'></p>", {'escape_lt_in_attrs': True}, '<p a="x &lt;"></p>'),
    ('a&lt;b&amp;&gt;\xa0', {}, 'a&lt;b&amp;&gt;\xa0'),
    ('<script>a<b</script><style>&</style>', {}, '<script>a<b</script><style>&</style>'),
    ('<script>a<b</script>', {'escape_rcdata': True}, '<script>a&lt;b</script>'),
    ('<!-- c -->', {}, '<!-- c -->'),
    ('<p>a \n\t b</p><pre>a\n  b</pre>', {'strip_whitespace': True}, '<p>a b</p><pre>a\n  b</pre>'),
    ('<template><p>x</template>', {}, '<template><p>x</p></template>'),
    ('<svg viewBox=1 xlink:href=u><path/></svg>', {}, '<svg xlink:href=u viewBox=1><path></path></svg>'),
    ('<textarea><b></textarea>', {}, '<textarea>&lt;b&gt;</textarea>'),
]
#: Documents that come out as they went in, but for html, head and body behind them.
DOCTYPES = ['<!DOCTYPE html>', '<!DOCTYPE html SYSTEM "x">', '<!DOCTYPE html PUBLIC "p">', '<!DOCTYPE html PUBLIC "p" "s">']
TEXT_PAGE = '<title>T</title><body>a<script>s1</script><style>s2</style><!--c--><p> b <i>c</i></p><svg><style>d</style></svg><input value=v><textarea>w</textarea><template>no</template>\xa0'
#: (options of text, the text of TEXT_PAGE's body).
TEXTS = [
    ({}, 'a b cdw\xa0'),
    ({'separator': '|'}, 'a| b |c|d|w|\xa0'),
    ({'separator': '|', 'strip': True}, 'a|b|c|d|w'),
    ({'include_script': True, 'include_style': True}, 'as1s2 b cdw\xa0'),
    ({'include_inputs': True, 'separator': '-', 'strip': True}, 'a-b-c-d-v-w'),
    ({'deep': False}, 'a\xa0'),
    ({'separator': "'\\\n", 'strip': True}, "a'\\\nb'\\\nc'\\\nd'\\\nw"),
]
#: (bytes, transport label, encoding).
ENCODINGS = [
    (b'<p>', None, 'windows-1252'),
    (b'\xef\xbb\xbf<p>', None, 'utf-8'),
    (b'\xff\xfe<\x00', None, 'utf-16le'),
    (b'\xfe\xff\x00<', None, 'utf-16be'),
    (b'<meta charset=utf-8>', None, 'utf-8'),
    (b"<META CHARSET='Latin2'/>", None, 'iso-8859-2'),
    (b'<meta charset=utf-16>', None, 'utf-8'),
    (b'<meta charset=nope><meta charset=euc-jp>', None, 'euc-jp'),
    (b"<meta http-equiv=Content-Type content='text/html; charset=utf8'>", None, 'utf-8'),
    (b"<meta content='text/html; charset=utf8'>", None, 'windows-1252'),
    (b'<!-- <meta charset=utf-8> --><meta charset=l2>', None, 'iso-8859-2'),
    (b"<a title='<meta charset=utf-8>'>", None, 'windows-1252'),
    (b'<meta charset=utf-8', None, 'windows-1252'),
    (b"x" * 1100 + b"<meta charset=utf-8>", None, "windows-1252"),
    (b"<!--" + b"x" * 3000 + b"--><meta charset=utf-8>", None, "utf-8"),
    (b'\xef\xbb\xbf', 'euc-jp', 'euc-jp'),
    (b'<meta charset=utf-8>', 'nope', 'utf-8'),
    (b'<meta charset=utf-8 charset=l2>', None, 'utf-8'),
    (b'', None, 'windows-1252'),
]
#: (bytes, transport label, text).
DECODED = [
    (b"\xe9\x80", None, "\xe9\u20ac"),
    (b"\xc3\xa9", "utf-8", "\xe9"),
    (b"\xef\xbb\xbf\xc3\xa9", None, "\xe9"),
    (b"\xff\xfea\0\xe9\0", None, "a\xe9"),
    (b"\xfe\xff\0a\0\xe9", None, "a\xe9"),
    (b"\xb1\xe6", "latin-2", "\u0105\u0107"),
    (b"\xa4\xa2", "euc-jp", "\u3042"),
    (b"a\0\xe9\0", "utf-16le", "a\xe9"),
    (b"\xc3", "utf-8", "\ufffd"),
]

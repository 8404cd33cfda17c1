"""A small labelled table of pages: blocks of main text begin with a plus sign, all others are page furniture.

Every page is there twice: as written, and with bare divs in place of all elements and
names that say what they hold, so that only words and links tell its blocks apart.
"""

import re

WRITTEN = (
    # An article element with short and long paragraphs; an advert that reads like prose.
    """<html><head><title>Harbour</title></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">Sport</a></li></ul></nav>
    <div class="ad">Our mattresses carry you through the night, and the first hundred nights are free.</div>
    <article><h1>+Harbour opens after repairs</h1><p>+The harbour opened again on Monday after eleven weeks of repairs to the outer wall, the port office said.</p>
    <p>+Quiet.</p><p>+Ferries run every hour.</p><p>+Two cranes that were ordered in spring have not arrived, and large ships must still wait outside.</p><p>+More to come.</p></article>
    <footer>&copy; Harbour Times. <a href="/p">Privacy</a></footer></body></html>""",
    # Reader comments inside the article, a share bar, related links.
    """<body><header><a href="/">Daily Lamp</a><p>Light for everyone since 1911</p></header><main><article><header><h1>+Why lamps flicker</h1></header>
    <p>+A lamp flickers when its supply changes faster than the filament cools, which old wiring makes likely.</p><h2>+What to check</h2><ul><li>+Loose screws</li><li>+Worn sockets and <a href="/w">old wires</a></li></ul>
    <p>+Call someone if it <a href="/x">smells</a>.</p><div class="share-bar"><a href="/f">Share</a> <a href="/t">Post</a></div>
    <section id="comments"><h3>Comments</h3><div class="comment"><p>I changed the socket as you said and the lamp has been steady ever since, thank you so much for this.</p></div><div class="comment"><p>Same here.</p></div></section></article></main>
    <aside><h4>Most read</h4><ul><li><a href="/1">Ten candles</a></li><li><a href="/2">Torches compared by our staff</a></li></ul></aside><footer><p>Imprint and contact</p></footer></body>""",
    # No article element, but a content box; a cookie notice and a form.
    """<body><div id="cookie-notice"><p>We and our partners store cookies on this device to measure visits and to show adverts that suit you.</p><a href="/ok">Accept</a></div>
    <div class="top-menu"><a href="/">Start</a> <a href="/blog">Blog</a> <a href="/about">About</a></div>
    <div id="content"><h1>+Bread without kneading</h1><p>+Stir flour, water, salt and very little yeast, cover the bowl and forget about it until tomorrow.</p><p>+Bake hot.</p><blockquote>+Patience is the only skill it takes.</blockquote>
    <form><p>Get a recipe by mail every Friday morning, free of charge.</p><label>Address</label></form></div>
    <div class="sidebar"><h3>About me</h3><p>I bake in a small kitchen by the sea and write about what comes out of the oven.</p></div><div id="footer">All rights reserved</div></body>""",
    # Plain markup: only words and links tell.
    """<body><table><tr><td><a href="/1">Index</a></td><td><a href="/2">Archive</a></td><td><a href="/3">Links</a></td></tr></table>
    <h2>+Notes from the observatory</h2><p>+Clouds hid the comet until two in the morning, when the wind turned and the whole eastern sky cleared within minutes.</p>
    <p>+We took forty plates. The best of them show a tail of three degrees with a faint spike towards the sun.</p><p>+The next clear night is expected on Thursday, and visitors may use the small telescope after sunset.</p>
    <p><a href="/p">Previous</a> <a href="/n">Next</a></p><p>Last changed in May</p></body>""",
    """<body><p><a href="/h">Home</a> | <a href="/m">Map</a> | <a href="/s">Search</a></p><div>+The committee met on the third of April and heard both reports in full before it adjourned for lunch.</div>
    <div>+After lunch the treasurer explained why the roof had cost twice what had been planned for it last year.</div><div>+A vote was put off until the autumn meeting, since several members had left to catch their train home.</div>
    <div><a href="/a1">Minutes of March</a></div><div><a href="/a2">Minutes of February</a></div><div>Hosted by Parish Net</div></body>""",
    # A long sidebar and an advert between paragraphs.
    """<body><div role="navigation"><a href="/">Front</a><a href="/w">World</a></div><div class="post"><h1>+Snow closes the pass</h1><p>+Snow fell through the night and the pass is closed to all traffic until further notice.</p>
    <div class="advert"><p>Winter tyres at half the price, fitted while you wait in our warm and friendly lounge.</p></div><p>+Trains still run.</p><p>+Drivers are asked to take the tunnel, where queues of an hour were seen at noon.</p></div>
    <div class="widget"><p>The editors choose the best of the week for you and explain why each story matters to the valley.</p></div><div class="newsletter-box"><p>Sign up and never miss a story again.</p></div></body>""",
    """<body><div class="masthead">The Valley Post</div><div class="breadcrumbs"><a href="/">Home</a> &gt; <a href="/c">Culture</a></div><main><h1>+A museum for maps</h1><p>+In the old customs house a museum now shows six hundred years of maps of the river.</p>
    <figure><figcaption>+The oldest map, drawn on calfskin</figcaption></figure><p>+Entrance is free.</p><p>+It is open daily except Mondays.</p></main><div class="related-stories"><h3>Read next</h3><p><a href="/b">The bridge that never was, and the man who drew it</a></p></div><footer><ul><li>Contact</li><li>Terms</li></ul></footer></body>""",
    # A discussion page: the post is the article, replies are not.
    """<body><nav>Forum index</nav><div id="main-content"><article><h1>+My bees left</h1><p>+Yesterday both hives were empty, with honey left in every frame and not a single dead bee on the ground.</p><p>+Any ideas?</p></article>
    <ol class="replies"><li><article class="comment"><p>It may have been a late swarm, look into the trees around you before it gets dark and cold again.</p></article></li><li><article class="comment"><p>Sorry to hear it.</p></article></li></ol></div></body>""",
    """<body><div class="notice"><p>This shop is closed for stocktaking until Tuesday; orders placed now leave on Wednesday.</p></div><article><p>+A kettle needs cleaning when a grey film covers its base.</p><p>+Vinegar.</p><p>+Boil it twice and rinse.</p><pre>+water 1
    vinegar 1</pre></article><div class="social"><p>Follow us</p></div><p>Designed by Northlight</p></body>""",
    # Much text, nothing else; and very little of it.
    """<body><p>+It was the custom of the house to bring the lamps at six, and to close the shutters on the side of the garden before anyone sat down to eat.</p><p>+Nobody remembered who had begun it, and nobody would have dared to ask.</p><p>+On the evening of the storm the lamps came late, and from this small change all the others followed in the years to come.</p></body>""",
    """<body><ul><li><a href="/1">Alpha group results</a></li><li><a href="/2">Beta group results</a></li></ul><div class="header">Results portal</div><article><h1>+Results</h1><p>+None yet.</p></article><footer>Portal &middot; <a href="/i">Imprint</a></footer></body>""",
    """<body><header class="site-header"><p>Independent reports on rivers, lakes and the people who live by them</p></header><nav><a href="/r">Rivers</a></nav><aside class="promo"><p>Members read without adverts and get our yearbook as a present in December.</p></aside>
    <article><h1>+Low water</h1><p>+The gauge at the mill stood at its lowest since records began, and barges carry half of their usual load.</p><p>+<a href="/d">Data here</a></p><p>+Rain is forecast.</p></article><form class="search"><p>Search all reports by river or year</p></form></body>""",
    # Prose beside the article that no name gives away.
    """<body><div><p>Readers of this page have saved eleven thousand crowns with our partners since the beginning of the year.</p></div><article><h1>+Ice on the lake</h1><p>+The ice is nine centimetres thick at the jetty and bears a single skater, but not a crowd.</p><p>+Stay near the shore.</p><p>+Flags mark the current.</p></article><div><p>This text was brought to you by the tourist board, which thanks all guests of the past season.</p></div><p>Version 2</p></body>""",
    """<body><span>Weather 4 degrees, light wind from the north, and some sun in the afternoon</span><article><p>+Short note.</p><p>+The library moves to the former school in March and will be closed for two weeks while its shelves are carried across the square.</p><p>+See you there</p></article><div>Printed on the paper of our own mill since the year of the great flood</div></body>""",
    """<body><div class="page"><p>+In the third year the orchard bore for the first time, and the whole street came to pick.</p><p>+Eleven kinds.</p><p>+What could not be eaten was pressed, and the juice kept until Easter in the cool cellar under the church.</p></div></body>""",
    """<body><nav><a href="/">Up</a></nav><article><h1>+One line</h1><p>+Done.</p></article></body>""",
    """<body><nav><ul><li><a href="/x">The</a></li><li><a href="/y">mill,</a></li></ul></nav><div class="ad">Buy two and pay one.</div><article><h1>+The wheel turns</h1><p><b>+The wheel turns<br><p>+Water is back in the race since Sunday, and the miller grinds by night as well.</p><p>+Slowly.""",
    # An article that ends in a list of its sources, and sections whose names only seem to name furniture.
    """<body><nav><a href="/">Institute</a> <a href="/p">Papers</a></nav><article class="post comments-open"><h1>+Tides in closed basins</h1><p>+A closed basin has tides of its own, a few millimetres high, which wind and air pressure hide on most days.</p>
    <section class="related-work"><h2>+Related work</h2><p>+Earlier surveys measured three lakes with floats and found nothing, since their floats were heavier than the tide was strong.</p><p>+Later ones used pressure gauges.</p></section>
    <div class="form-notes"><p>+The gauges were read by hand every hour for a year, and the readings were written into bound books that the institute still keeps.</p></div>
    <h2>+Sources</h2><ul><li>+<a href="/s1">Survey of the northern lakes</a></li><li>+<a href="/s2">Gauges and their errors</a></li><li>+<a href="/s3">A year of hourly readings</a></li></ul>
    <div class="related-stories"><h3>Read next</h3><p><a href="/n">The lake that empties itself every summer</a></p></div><div class="share-bar"><a href="/f">Share</a></div></article><footer>Institute of Waters</footer></body>""",
    """<body><header class="page-header"><a href="/">The Beacon</a></header><main><div class="story"><h1>+Night shift at the lighthouse</h1><p>+The keeper climbs two hundred steps at dusk, trims nothing and lights nothing, for the lamp has been electric for forty years.</p><ul><li>+Check the lens</li><li>+Log the weather</li><li>+Call the <a href="/c">coast guard</a></li></ul>
    <p>+Then the long watch begins, with tea, a radio and the sound of the sea far below the gallery.</p><div class="social-links"><a href="/a">Post</a> <a href="/b">Mail</a></div><div class="recommended-reading"><ul><li><a href="/r">Ships that never came home</a></li><li><a href="/q">Fog and how to hear it</a></li></ul></div></div></main><div class="site-notice"><p>We use a new sign-in.</p></div></body>""",
    """<body><nav><a href="/">Encyclopedia</a></nav><article><h1>+The guild of rope makers</h1><section class="social-history"><h2>+Social history</h2><p>+The guild took boys of twelve, who turned the wheel for three years before they were allowed to touch the hemp itself.</p><p>+Girls were not taken.</p></section><section class="form-factors"><h2>+Forms of rope</h2><p>+Ropes were laid left or right, and a sailor could tell the town of a rope by its lay, even at night and in the rain.</p></section>
    <section id="notice-board"><h2>+The notice board</h2><p>+Prices hung on a board beside the door, in chalk, and changed with every ship that brought hemp from the east.</p></section><div class="related-topics"><h3>See more</h3><ul><li><a href="/h">Hemp</a></li><li><a href="/w">Wheels</a></li></ul></div><div class="share-this"><p>Send to a friend</p><a href="/m">Mail</a></div></article></body>""",
    # Bare pages: menus and link lists around long paragraphs with a link here and there, and short lines at the end.
    """<body><div><div><a href="/1">Home</a></div><div><a href="/2">Blog</a></div><div><a href="/3">Archive</a></div><div><a href="/4">Contact us</a></div></div><div><h1>+How we moved the piano</h1><div>+It took six of us, two planks and a borrowed van to bring the piano from the third floor into the street below.</div><div>+The <a href="/v">van</a> belonged to a baker, and everything that we carried in it that week smelled of rye and caraway.</div><div>+Nobody was hurt.</div><div>+The piano was not in tune afterwards, but then it had not been in tune before, and its new owner does not play.</div></div>
    <div><h3>More stories</h3><div><a href="/5">How we lost the key</a></div><div><a href="/6">How we found it again under the stove</a></div></div><div>All rights reserved</div></body>""",
    """<body><ul><li><a href="/l1">Products and services</a></li><li><a href="/l2">Customer support</a></li><li><a href="/l3">Company</a></li></ul><h1>+New pumps for old wells</h1><p>+Wells that were dug by hand a century ago can be brought back with pumps that draw no more than a light bulb does.</p><p>+Three villages have tried it. Their wells had been dry for a decade because the water table had sunk below the reach of the hand pumps.</p><h2>+What it costs</h2><p>+A pump costs as much as a bicycle, and the panel that drives it about twice that, says the <a href="/coop">cooperative</a> that builds both.</p><p><a href="/l4">Terms</a> <a href="/l5">Privacy</a> <a href="/l6">Site map</a></p><p>Page 1 of 1</p></body>""",
    """<body><div><a href="/x1">Front page</a> <a href="/x2">Weather</a> <a href="/x3">Traffic</a></div><h2>+A bridge of ropes</h2><p>+Every spring the people of both banks meet and weave the bridge anew from grass ropes as thick as an arm.</p><p>+The old bridge is cut and falls into the gorge.</p><p>+Crossing it takes courage in any year, and in its last month rather more, since the ropes stretch until the middle nearly touches the river.</p><div><a href="/y1">The gorge in pictures</a></div><div><a href="/y2">Other bridges worth a walk</a></div><div><a href="/y3">Letters to the editor</a></div><div>Printed weekly</div></body>""",
)


def bare(page: str) -> str:
    """The page with divs for the elements, and without the names and roles, that say what they hold."""
    page = re.sub(r"<(/?)(?:nav|header|footer|aside|article|main|section|form|dialog)\b", r"<\1div", page)
    return re.sub(r"""\s(?:class|id|role)=(?:"[^"]*"|[^\s>]+)""", "", page)


PAGES = tuple(page for written in WRITTEN for page in (written, bare(written)))

"""Hand-written license signatures.

A rule is (priority, label, keyword, expression, example).  The expressions
are for lower-cased text, and a blank in one stands for a gap: a run of white
space, comment marks, quotes and punctuation between two words.  The keyword is
a part of every text that the expression matches.  Rules stand in order of
priority, from tags and legal texts to bare mentions; a mention has to name a
license beyond doubt, so words of everyday use ("python", "fair", "boost")
count only with what the license adds to them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: priority -> confidence: tags; grants and addresses; notices; titles with a version; plain titles; mentions.
CONFIDENCE = {6: 1.0, 5: 0.95, 4: 0.9, 3: 0.8, 2: 0.7, 1: 0.5}

#: Before the identifier of a tag, and before the value of a field.
TAG, FIELD = r"spdx-license-identifier:\s*+", r"licen[cs]e[\"']?\s*+[:=]\s*+[\"']?"

#: A version that may follow a title.
VERSION = r"(?: (?:version |v\.? ?)?[0-9]+(?:\.[0-9]+)*+)?"

_TEXT = (
    # --- tags: the identifier after "SPDX-License-Identifier:" ---
    (6, "mit", "spdx", TAG + r"(?:mit|mit-0|x11|expat)(?![a-z0-9.-])", "SPDX-License-Identifier: MIT"),
    (6, "apache", "spdx", TAG + r"apache-[12]\.[01](?![0-9])", "SPDX-License-Identifier: Apache-2.0"),
    (6, "gpl", "spdx", TAG + r"gpl-[123]\.0(?:-only|-or-later|\+)?", "// SPDX-License-Identifier: GPL-2.0-only"),
    (6, "lgpl", "spdx", TAG + r"lgpl-[23]\.[01](?:-only|-or-later|\+)?", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    (6, "agpl", "spdx", TAG + r"agpl-[13]\.0(?:-only|-or-later|\+)?", "SPDX-License-Identifier: AGPL-3.0-only"),
    (6, "gfdl", "spdx", TAG + r"gfdl-1\.[123](?:-only|-or-later)?", "SPDX-License-Identifier: GFDL-1.3"),
    (6, "bsd", "spdx", TAG + r"(?:bsd-[1234]-clause(?:-[a-z]+)?|0bsd)", "SPDX-License-Identifier: BSD-3-Clause"),
    (6, "mpl", "spdx", TAG + r"mpl-[12]\.[01](?:-no-copyleft-exception)?", "SPDX-License-Identifier: MPL-2.0"),
    (6, "epl", "spdx", TAG + r"epl-[12]\.0", "SPDX-License-Identifier: EPL-2.0"),
    (6, "cddl", "spdx", TAG + r"cddl-1\.[01]", "SPDX-License-Identifier: CDDL-1.0"),
    (6, "cpl", "spdx", TAG + r"(?:cpl|ipl)-1\.0", "SPDX-License-Identifier: CPL-1.0"),
    (6, "isc", "spdx", TAG + r"isc", "/* SPDX-License-Identifier: ISC */"),
    (6, "zlib", "spdx", TAG + r"(?:zlib(?:-acknowledgement)?|libpng(?:-2\.0)?)", "SPDX-License-Identifier: Zlib"),
    (6, "boost", "spdx", TAG + r"bsl-1\.0", "SPDX-License-Identifier: BSL-1.0"),
    (6, "artistic", "spdx", TAG + r"artistic-[12]\.0(?:-perl|-cl8)?", "SPDX-License-Identifier: Artistic-2.0"),
    (6, "unlicense", "spdx", TAG + r"unlicense", "SPDX-License-Identifier: Unlicense"),
    (6, "wtfpl", "spdx", TAG + r"wtfpl", "SPDX-License-Identifier: WTFPL"),
    (6, "cc0", "spdx", TAG + r"cc0-1\.0", "SPDX-License-Identifier: CC0-1.0"),
    (6, "cc-by", "spdx", TAG + r"cc-by-[1234]\.[05]", "SPDX-License-Identifier: CC-BY-4.0"),
    (6, "cc-by-sa", "spdx", TAG + r"cc-by-sa-[1234]\.[05]", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    (6, "cc-by-nc", "spdx", TAG + r"cc-by-nc(?:-sa|-nd)?-[1234]\.[05]", "SPDX-License-Identifier: CC-BY-NC-SA-4.0"),
    (6, "cc-by-nd", "spdx", TAG + r"cc-by-nd-[1234]\.[05]", "SPDX-License-Identifier: CC-BY-ND-4.0"),
    (6, "eupl", "spdx", TAG + r"eupl-1\.[012]", "SPDX-License-Identifier: EUPL-1.2"),
    (6, "cecill", "spdx", TAG + r"cecill-(?:[12]\.[01]|b|c)", "SPDX-License-Identifier: CECILL-2.1"),
    (6, "psf", "spdx", TAG + r"(?:psf|python)-2\.0", "SPDX-License-Identifier: PSF-2.0"),
    (6, "php", "spdx", TAG + r"php-3\.01?", "SPDX-License-Identifier: PHP-3.01"),
    (6, "openssl", "spdx", TAG + r"(?:openssl|ssleay)(?:-standalone)?", "SPDX-License-Identifier: OpenSSL"),
    (6, "ofl", "spdx", TAG + r"ofl-1\.[01](?:-no-rfn|-rfn)?", "SPDX-License-Identifier: OFL-1.1"),
    (6, "odbl", "spdx", TAG + r"odbl-1\.0", "SPDX-License-Identifier: ODbL-1.0"),
    (6, "ms-pl", "spdx", TAG + r"ms-pl", "SPDX-License-Identifier: MS-PL"),
    (6, "ms-rl", "spdx", TAG + r"ms-rl", "SPDX-License-Identifier: MS-RL"),
    (6, "sspl", "spdx", TAG + r"sspl-1\.0", "SPDX-License-Identifier: SSPL-1.0"),
    (6, "busl", "spdx", TAG + r"busl-1\.1", "SPDX-License-Identifier: BUSL-1.1"),
    (6, "postgresql", "spdx", TAG + r"postgresql", "SPDX-License-Identifier: PostgreSQL"),
    (6, "afl", "spdx", TAG + r"afl-[123]\.[012]", "SPDX-License-Identifier: AFL-3.0"),
    (6, "osl", "spdx", TAG + r"osl-[123]\.[01]", "SPDX-License-Identifier: OSL-3.0"),
    (6, "ncsa", "spdx", TAG + r"ncsa", "SPDX-License-Identifier: NCSA"),
    (6, "upl", "spdx", TAG + r"upl-1\.0", "SPDX-License-Identifier: UPL-1.0"),
    (6, "mulan", "spdx", TAG + r"mulanpsl-[12]\.0", "SPDX-License-Identifier: MulanPSL-2.0"),
    (6, "proprietary", "spdx", TAG + r"licenseref-[a-z0-9.-]*proprietary", "SPDX-License-Identifier: LicenseRef-Acme-Proprietary"),
    # --- grants and conditions of the legal texts ---
    (5, "mit", "granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"),
    (5, "mit", "granted", r"permission is hereby granted free of charge to any person obtaining a copy", "Permission is hereby granted, free of charge, to any person obtaining a copy of these files"),
    (5, "mit", "sublicense", r"without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies", "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies"),
    (5, "mit", "substantial", r"this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software", "The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software."),
    (5, "x11-consortium", "consortium", r"name of the x consortium shall not be used in advertising", "the name of the X Consortium shall not be used in advertising"),
    (5, "isc", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    (5, "isc", "permission", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", "Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted"),
    (5, "isc", "author", r"the software is provided as is and (?:the author|isc) disclaims all warranties with regard to this software", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE'),
    (5, "bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", "Redistribution and use in source and binary forms, with or without\n * modification, are permitted"),
    (5, "bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice", "2. Redistributions in binary form must reproduce the above copyright notice"),
    (5, "bsd", "redistributions", r"redistributions of source code must retain the above copyright notice", "1. Redistributions of source code must retain the above copyright notice"),
    (5, "bsd", "endorse", r"neither the name of .{1,200}? nor the names of its contributors may be used to endorse or promote products", "Neither the name of the University nor the names of its contributors may be used to endorse or promote products"),
    (5, "bsd", "advertising", r"all advertising materials mentioning features or use of this software must display", "3. All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    (5, "bsd", "copyright holders", r"provided by the copyright holders and contributors as is and any express or implied warranties", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES'),
    (5, "bsd", "regents", r"copyright (?:c )?(?:[0-9]{4} ){0,12}the regents of the university of california", "Copyright (c) 1989, 1993 The Regents of the University of California"),
    (5, "apache", "apache", r"licensed to the apache software foundation (?:asf )?under one or more contributor license agreements", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements"),
    (5, "apache", "apache", r"licensed under the apache license version 2\.0 the license", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    (5, "apache", "compliance", r"you may not use this file except in compliance with the license you may obtain a copy of the license at https?://www\.apache\.org", "you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org"),
    (5, "apache", "royalty-free", r"each contributor hereby grants to you a perpetual worldwide non-exclusive no-charge royalty-free irrevocable", "each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable"),
    (5, "apache", "apache", r"this product includes software developed (?:by|at) the apache software foundation", "This product includes software developed at\nThe Apache Software Foundation"),
    (5, "apache", "apache.org/licenses", r"https?://(?:www\.)?apache\.org/licenses/license-[12]\.[01]", "http://www.apache.org/licenses/LICENSE-2.0"),
    (5, "gpl", "redistribute", r"this (?:program|file|software|library|package) is free software you can redistribute it and or modify it under the terms of the gnu general public license", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License"),
    (5, "gpl", "received a copy", r"you should have received a copy of the gnu general public license along with", "You should have received a copy of the GNU General Public License\nalong with this program"),
    (5, "gpl", "general public", r"gnu general public license as published by the free software foundation", "GNU General Public License as published by the Free Software Foundation"),
    (5, "gpl", "gnu.org", r"https?://(?:www\.)?gnu\.org/(?:copyleft|licenses(?:/old-licenses)?)/gpl(?:-[123]\.0)?", "https://www.gnu.org/licenses/gpl-3.0.html"),
    (5, "gpl", "share and change", r"the gnu general public license is intended to guarantee your freedom to share and change", "the GNU General Public License is intended to guarantee your freedom to share and change"),
    (5, "gpl", "class path", r"linking this library statically or dynamically with other modules is making a combined work", "Linking this library statically or dynamically with other modules is making a combined work (class path exception)"),
    (5, "lgpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    (5, "lgpl", "received a copy", r"you should have received a copy of the gnu (?:lesser|library) general public license along with", "You should have received a copy of the GNU Lesser General Public License along with this library"),
    (5, "lgpl", "general public", r"gnu (?:lesser|library) general public license as published by the free software foundation", "GNU Library General Public License as published by the Free Software Foundation"),
    (5, "lgpl", "gnu.org", r"https?://(?:www\.)?gnu\.org/(?:copyleft/lesser|licenses/(?:old-licenses/)?lgpl)", "http://www.gnu.org/licenses/lgpl-2.1.html"),
    (5, "agpl", "affero", r"under the terms of the gnu affero general public license", "under the terms of the GNU Affero General Public License"),
    (5, "agpl", "affero", r"you should have received a copy of the gnu affero general public license", "You should have received a copy of the GNU Affero General Public License"),
    (5, "agpl", "gnu.org", r"https?://(?:www\.)?gnu\.org/licenses/agpl", "https://www.gnu.org/licenses/agpl-3.0.en.html"),
    (5, "gfdl", "free documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License"),
    (5, "gfdl", "invariant sections", r"with no invariant sections no front-cover texts and no back-cover texts", "with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts"),
    (5, "gfdl", "gnu.org", r"https?://(?:www\.)?gnu\.org/licenses/fdl", "https://www.gnu.org/licenses/fdl-1.3.html"),
    (5, "mpl", "mozilla", r"this source code form is subject to the terms of the mozilla public license", "This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0."),
    (5, "mpl", "mozilla", r"the contents of this file are subject to the mozilla public license", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    (5, "mpl", "mozilla.org", r"https?://(?:www\.)?mozilla\.org/(?:en-us/)?mpl(?:/[12]\.[01])?", "https://mozilla.org/MPL/2.0/"),
    (5, "mpl", "if a copy of the mpl", r"if a copy of the mpl was not distributed with this file", "If a copy of the MPL was not distributed with this file"),
    (5, "epl", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0"),
    (5, "epl", "eclipse.org", r"https?://(?:www\.)?eclipse\.org/legal/epl-(?:v10|2\.0|v20)", "http://www.eclipse.org/legal/epl-v10.html"),
    (5, "cddl", "common development", r"the contents of this file are subject to the terms of (?:either the gnu general public license .{0,120}? or )?the common development and distribution license", "The contents of this file are subject to the terms of the Common Development and Distribution License"),
    (5, "cddl", "cddl header", r"cddl header (?:start|end)", "CDDL HEADER START"),
    (5, "cpl", "common public", r"this program and the accompanying materials are made available under the terms of the common public license", "This program and the accompanying materials are made available under the terms of the Common Public License"),
    (5, "zlib", "as-is", r"this software is provided as-is without any express or implied warranty in no event will the authors be held liable", "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable"),
    (5, "zlib", "misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software"),
    (5, "zlib", "altered", r"altered source versions must be plainly marked as such", "Altered source versions must be plainly marked as such"),
    (5, "boost", "boost software", r"distributed under the boost software license version 1\.0", "Distributed under the Boost Software License, Version 1.0."),
    (5, "boost", "boost.org", r"https?://(?:www\.)?boost\.org/license_1_0\.txt", "http://www.boost.org/LICENSE_1_0.txt"),
    (5, "boost", "granted", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software"),
    (5, "artistic", "perl itself", r"(?:under|by) the same terms as perl(?: 5)? itself", "it under the same terms as Perl itself"),
    (5, "artistic", "artistic", r"intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control", "The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control"),
    (5, "artistic", "perlfoundation", r"https?://(?:www\.)?perlfoundation\.org/artistic_license_2_0", "http://www.perlfoundation.org/artistic_license_2_0"),
    (5, "unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", "This is free and unencumbered software released into the public domain."),
    (5, "unlicense", "unlicense.org", r"https?://(?:www\.)?unlicense\.org", "<https://unlicense.org>"),
    (5, "wtfpl", "do what the fuck", r"do what the fuck you want to public licen[cs]e", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
    (5, "wtfpl", "wtfpl.net", r"https?://(?:www\.)?wtfpl\.net", "http://www.wtfpl.net/"),
    (5, "cc0", "waived", r"to the extent possible under law .{1,200}? has waived all copyright and related or neighboring rights", "To the extent possible under law, the author has waived all copyright and related or neighboring rights"),
    (5, "cc0", "creativecommons.org", r"https?://creativecommons\.org/publicdomain/zero/1\.0", "https://creativecommons.org/publicdomain/zero/1.0/"),
    (5, "public-domain", "creativecommons.org", r"https?://creativecommons\.org/publicdomain/mark/1\.0", "https://creativecommons.org/publicdomain/mark/1.0/"),
    (5, "cc-by", "creativecommons.org", r"https?://creativecommons\.org/licenses/by/[1234]\.[05]", "https://creativecommons.org/licenses/by/4.0/"),
    (5, "cc-by-sa", "creativecommons.org", r"https?://creativecommons\.org/licenses/by-sa/[1234]\.[05]", "https://creativecommons.org/licenses/by-sa/3.0/"),
    (5, "cc-by-nc", "creativecommons.org", r"https?://creativecommons\.org/licenses/by-nc(?:-sa|-nd)?/[1234]\.[05]", "https://creativecommons.org/licenses/by-nc-sa/4.0/"),
    (5, "cc-by-nd", "creativecommons.org", r"https?://creativecommons\.org/licenses/by-nd/[1234]\.[05]", "https://creativecommons.org/licenses/by-nd/4.0/"),
    (5, "eupl", "eupl", r"licensed under the eupl version 1\.[012]", "Licensed under the EUPL, Version 1.2"),
    (5, "cecill", "cecill", r"this software is governed by the cecill(?:-b|-c)? licen[cs]e under french law", "This software is governed by the CeCILL license under French law"),
    (5, "cecill", "cecill.info", r"https?://(?:www\.)?cecill\.info", "http://www.cecill.info"),
    (5, "psf", "python software", r"this license agreement is between the python software foundation", 'This LICENSE AGREEMENT is between the Python Software Foundation ("PSF")'),
    (5, "psf", "beopen", r"beopen python open source license agreement", "BEOPEN PYTHON OPEN SOURCE LICENSE AGREEMENT VERSION 1"),
    (5, "psf", "python.org", r"https?://(?:www\.)?python\.org/psf/license", "http://www.python.org/psf/license"),
    (5, "php", "php", r"this source file is subject to version [23]\.[0-9]{1,2} of the php license", "This source file is subject to version 3.01 of the PHP license"),
    (5, "php", "php.net", r"https?://(?:www\.)?php\.net/license/[23]_[0-9]{1,2}\.txt", "http://www.php.net/license/3_01.txt"),
    (5, "ruby", "ruby", r"you can redistribute it and or modify it under (?:either )?(?:the terms of the 2 clause bsdl|the same terms as ruby)", "You can redistribute it and/or modify it under the same terms as Ruby"),
    (5, "openssl", "openssl", r"this product includes software developed by the openssl project", "This product includes software developed by the OpenSSL Project"),
    (5, "openssl", "eric young", r"this product includes cryptographic software written by eric young", "This product includes cryptographic software written by Eric Young"),
    (5, "ofl", "font software", r"this font software is licensed under the sil open font license", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    (5, "ofl", "reserved font name", r"with reserved font name", "Copyright 2011, with Reserved Font Name Lobster."),
    (5, "ofl", "scripts.sil.org", r"https?://scripts\.sil\.org/ofl", "http://scripts.sil.org/OFL"),
    (5, "odbl", "opendatacommons", r"https?://(?:www\.)?opendatacommons\.org/licenses/odbl", "http://opendatacommons.org/licenses/odbl/1.0/"),
    (5, "pddl", "opendatacommons", r"https?://(?:www\.)?opendatacommons\.org/licenses/pddl", "http://www.opendatacommons.org/licenses/pddl/1.0/"),
    (5, "odc-by", "opendatacommons", r"https?://(?:www\.)?opendatacommons\.org/licenses/by", "https://opendatacommons.org/licenses/by/1-0/"),
    (5, "ms-pl", "this license governs", r"this license governs use of the accompanying software if you use the software you accept this license", "This license governs use of the accompanying software. If you use the software, you accept this license."),
    (5, "sspl", "server side public", r"under the terms of the server side public license", "under the terms of the Server Side Public License, version 1"),
    (5, "sspl", "mongodb.com", r"https?://(?:www\.)?mongodb\.com/licensing/server-side-public-license", "https://www.mongodb.com/licensing/server-side-public-license"),
    (5, "busl", "business source", r"use of this software is governed by the business source license", "Use of this software is governed by the Business Source License"),
    (5, "busl", "additional use grant", r"additional use grant", "Additional Use Grant: None"),
    (5, "postgresql", "permission", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"),
    (5, "vim", "uganda", r"vim is charityware you can use and copy it as much as you like but you are encouraged to make a donation for needy children in uganda", "Vim is Charityware. You can use and copy it as much as you like, but you are encouraged to make a donation for needy children in Uganda"),
    (5, "afl", "academic free", r"licensed under the academic free license version [123]\.[012]", "Licensed under the Academic Free License version 3.0"),
    (5, "osl", "open software", r"licensed under the open software license version [123]\.[01]", "Licensed under the Open Software License version 3.0"),
    (5, "ncsa", "illinois", r"university of illinois ncsa open source license", "University of Illinois/NCSA Open Source License"),
    (5, "w3c", "w3c", r"this work is (?:being )?provided by the copyright holders under the following license", "This work is being provided by the copyright holders under the following license. W3C"),
    (5, "upl", "universal permissive", r"the universal permissive license upl(?: version 1\.0)?", "The Universal Permissive License (UPL), Version 1.0"),
    (5, "beerware", "buy me a beer", r"you can do whatever you want with this stuff if we meet some day and you think this stuff is worth it you can buy me a beer", "you can do whatever you want with this stuff. If we meet some day, and you think this stuff is worth it, you can buy me a beer"),
    (5, "mulan", "mulan", r"you can use this software according to the terms and conditions of the mulan psl", "You can use this software according to the terms and conditions of the Mulan PSL v2"),
    (5, "fair", "instrument is retained", r"usage of the works is permitted provided that this instrument is retained with the works", "Usage of the works is permitted provided that this instrument is retained with the works"),
    (5, "curl", "permission", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice"),
    (5, "json", "for good", r"the software shall be used for good not evil", "The Software shall be used for Good, not Evil."),
    (5, "public-domain", "public domain", r"(?:is|are|was|been) (?:hereby )?(?:released|placed|dedicated) (?:by .{1,60}? )?(?:in|into|to) the public domain", "This file has been placed in the public domain."),
    (5, "public-domain", "disclaims copyright", r"the author disclaims copyright to this source code", "The author disclaims copyright to this source code."),
    (5, "proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)", "Proprietary and confidential."),
    (5, "proprietary", "unauthorized", r"unauthorized (?:copying|reproduction|use)(?: or distribution)? of this (?:file|software|document|work).{0,60}? is strictly prohibited", "Unauthorized copying of this file, via any medium, is strictly prohibited"),
    (5, "proprietary", "user", r"end user licen[cs]e agreement", "END-USER LICENSE AGREEMENT"),
    (5, "proprietary", "nondisclosure", r"subject to the terms of (?:a|the) non ?disclosure agreement", "subject to the terms of a nondisclosure agreement"),
    (5, "freetype", "freetype", r"portions of this software are copyright .{1,80}? the freetype project", "Portions of this software are copyright (c) 2006 The FreeType Project"),
    (5, "ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group", "this software is based in part on the work of the Independent JPEG Group"),
    (5, "unicode", "unicode", r"permission is hereby granted free of charge to any person obtaining a copy of (?:the )?unicode data files", "Permission is hereby granted, free of charge, to any person obtaining a copy of the Unicode data files"),
    (5, "lppl", "latex project", r"this work may be distributed and or modified under the conditions of the latex project public license", "This work may be distributed and/or modified under the conditions of the LaTeX Project Public License"),
    (5, "bitstream-vera", "bitstream", r"bitstream vera is a trademark of bitstream", "Bitstream Vera is a trademark of Bitstream, Inc."),
    (5, "hpnd", "advertising", r"permission to use copy modify and distribute this software and its documentation for any purpose .{0,40}? is hereby granted .{0,400}? not be used in advertising or publicity", "Permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the name of the author not be used in advertising or publicity"),
    (5, "libpng", "libpng", r"the png reference library is supplied as is", "The PNG Reference Library is supplied \"AS IS\". See libpng."),
    (5, "free-art", "artlibre", r"https?://(?:www\.)?artlibre\.org", "http://artlibre.org/licence/lal/en"),
    (5, "rail", "use-based restrictions", r"use-based restrictions", "the Use-based restrictions set forth in Attachment A"),
    (5, "llama", "llama", r"by clicking i accept .{1,200}? llama", "By clicking \"I Accept\" below or by using any portion of the Llama Materials"),
    (5, "ogl", "open-government-licen", r"https?://(?:www\.)?nationalarchives\.gov\.uk/doc/open-government-licence", "http://www.nationalarchives.gov.uk/doc/open-government-licence/version/3/"),
    # --- notices: "licensed under ..." and the like ---
    (4, "mit", "mit", r"(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?(?:open source )?(?:mit(?: x11| expat)?|expat|x11) licen[cs]e" + VERSION, "Released under the MIT License."),
    (4, "mit", "mit", r"mit licensed", "This crate is MIT licensed."),
    (4, "apache", "apache", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?apache(?: software)? licen[cs]e(?: v(?:ersion)?\.? ?[12](?:\.[01])?)?", "Released under the Apache Software License"),
    (4, "apache", "apache", r"apache licensed", "an Apache-licensed library"),
    (4, "gpl", "gpl", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?(?:gnu )?gpl(?: ?v(?:ersion)?\.? ?[123](?:\.0)?)?", "This plugin is licensed under the GNU GPL v2"),
    (4, "gpl", "general public", r"(?:licensed|released|distributed|available|published|covered) (?:under|by) (?:the )?(?:terms of the )?(?:gnu )?general public licen[cs]e" + VERSION, "distributed under the General Public License"),
    (4, "gpl", "gpl", r"gpl(?:ed|'d| licensed)", "a GPL-licensed program"),
    (4, "lgpl", "lgpl", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?(?:gnu )?lgpl", "released under the LGPL"),
    (4, "lgpl", "lesser", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?(?:gnu )?lesser general public licen[cs]e" + VERSION, "Available under the GNU Lesser General Public License"),
    (4, "agpl", "agpl", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?(?:gnu )?agpl", "licensed under the AGPL"),
    (4, "bsd", "bsd", r"(?:licensed|released|distributed|available|published) under (?:(?:a|the) )?(?:terms of the )?(?:(?:new|modified|simplified|revised|[234] clause) )?bsd(?: style)? licen[cs]e" + VERSION, "Released under the 3-clause BSD license"),
    (4, "bsd", "bsd", r"use of this source code is governed by a bsd style licen[cs]e" + VERSION, "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    (4, "bsd", "bsd", r"bsd licensed", "BSD-licensed code"),
    (4, "mpl", "mpl", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?mpl(?: ?v?[12]\.[01])?", "licensed under the MPL 2.0"),
    (4, "mpl", "mozilla", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?mozilla public licen[cs]e" + VERSION, "released under the Mozilla Public License"),
    (4, "epl", "eclipse", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?eclipse public licen[cs]e" + VERSION, "distributed under the Eclipse Public License"),
    (4, "isc", "isc", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?isc licen[cs]e" + VERSION, "Licensed under the ISC license"),
    (4, "zlib", "zlib", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?zlib(?: libpng)? licen[cs]e" + VERSION, "released under the zlib/libpng license"),
    (4, "boost", "boost", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?boost(?: software)? licen[cs]e" + VERSION, "Available under the Boost license"),
    (4, "artistic", "artistic", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?(?:perl )?artistic licen[cs]e" + VERSION, "distributed under the Artistic License"),
    (4, "unlicense", "unlicense", r"(?:licensed|released|distributed|available|published) under (?:the )?unlicense", "released under the Unlicense"),
    (4, "wtfpl", "wtfpl", r"(?:licensed|released|distributed|available|published) under (?:the )?wtfpl", "licensed under the WTFPL"),
    (4, "cc0", "cc0", r"(?:licensed|released|distributed|available|published|dedicated) (?:under|using|via) (?:the )?(?:creative commons )?cc0", "Data released under CC0"),
    (4, "cc-by", "creative commons", r"(?:licensed|released|distributed|available|published) under (?:(?:a|the) )?creative commons attribution(?: [1234]\.[05])?(?: international)? licen[cs]e" + VERSION, "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (4, "cc-by-sa", "creative commons", r"(?:licensed|released|distributed|available|published) under (?:(?:a|the) )?creative commons attribution share ?alike", "Text is available under the Creative Commons Attribution-ShareAlike License"),
    (4, "cc-by-nc", "creative commons", r"(?:licensed|released|distributed|available|published) under (?:(?:a|the) )?creative commons attribution non ?commercial", "licensed under a Creative Commons Attribution-NonCommercial 3.0 License"),
    (4, "cc-by-nd", "creative commons", r"(?:licensed|released|distributed|available|published) under (?:(?:a|the) )?creative commons attribution no ?deriv(?:ative)?s?", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 License"),
    (4, "eupl", "european union", r"(?:licensed|released|distributed|available|published) under (?:the )?european union public licen[cs]e" + VERSION, "Released under the European Union Public Licence"),
    (4, "psf", "python software", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?(?:python software foundation|psf) licen[cs]e" + VERSION, "Distributed under the PSF license / Python Software Foundation License"),
    (4, "ofl", "open font", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:sil )?open font licen[cs]e" + VERSION, "Fonts available under the Open Font License"),
    (4, "odbl", "open database", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:open data commons )?open database licen[cs]e" + VERSION, "made available under the Open Database License"),
    (4, "ms-pl", "microsoft public", r"(?:licensed|released|distributed|available|published) under (?:the )?microsoft public licen[cs]e" + VERSION, "Released under the Microsoft Public License"),
    (4, "sspl", "sspl", r"(?:licensed|released|distributed|available|published) under (?:the )?sspl", "now licensed under the SSPL"),
    (4, "elastic", "elastic license", r"(?:licensed|released|distributed|available|published) under (?:the )?elastic licen[cs]e" + VERSION, "licensed under the Elastic License 2.0"),
    (4, "commons-clause", "commons clause", r"commons clause licen[cs]e condition", '"Commons Clause" License Condition v1.0'),
    (4, "dual", "dual", r"dual licensed under", "This crate is dual-licensed under MIT and Apache 2.0"),
    (4, "see-file", "license", r"see (?:the )?(?:accompanying )?(?:file )?licen[cs]e(?: txt| md)? (?:file )?for (?:the )?(?:full )?(?:license|licence|copyright|terms|details)", "See the LICENSE file for details."),
    (4, "proprietary", "all rights reserved", r"copyright(?: c)? ?©? ?[0-9]{4}.{0,80}? all rights reserved", "Copyright (c) 2020 Example Corp. All rights reserved."),
    # --- titles with a version ---
    (3, "apache", "apache", r"apache licen[cs]e (?:version |v\.? ?)?[12]\.[01]", "Apache License, Version 2.0"),
    (3, "apache", "apache", r"apache 2(?:\.0)?(?: licen[cs]e)", "Apache 2.0 License"),
    (3, "gpl", "general public", r"gnu general public licen[cs]e (?:version |v\.? ?)[123](?:\.0)?", "GNU General Public License version 3"),
    (3, "gpl", "gpl", r"gpl ?v[123](?:\.0)?\+?", "GPLv3+"),
    (3, "lgpl", "general public", r"gnu (?:lesser|library) general public licen[cs]e (?:version |v\.? ?)[23](?:\.[01])?", "GNU Lesser General Public License v2.1"),
    (3, "lgpl", "lgpl", r"lgpl ?-?v[23](?:\.[01])?\+?", "LGPLv3"),
    (3, "agpl", "affero", r"(?:gnu )?affero general public licen[cs]e (?:version |v\.? ?)[13](?:\.0)?", "GNU Affero General Public License v3.0"),
    (3, "agpl", "agpl", r"agpl ?-?v[13](?:\.0)?\+?", "AGPLv3"),
    (3, "gfdl", "free documentation", r"gnu free documentation licen[cs]e (?:version |v\.? ?)1\.[123]", "GNU Free Documentation License, Version 1.3"),
    (3, "bsd", "bsd", r"(?:[234] clause|new|simplified|revised|modified) bsd licen[cs]e", "The 2-Clause BSD License"),
    (3, "bsd", "clause", r"bsd [234] clause(?: licen[cs]e)?", "BSD 3-Clause License"),
    (3, "mpl", "mozilla", r"mozilla public licen[cs]e (?:version |v\.? ?)?[12]\.[01]", "Mozilla Public License 2.0"),
    (3, "epl", "eclipse", r"eclipse public licen[cs]e (?:version |v\.? ?)?[12]\.0", "Eclipse Public License - v 2.0"),
    (3, "cddl", "common development", r"common development and distribution licen[cs]e (?:cddl )?(?:version |v\.? ?)?1\.[01]", "Common Development and Distribution License 1.0"),
    (3, "cpl", "common public", r"common public licen[cs]e (?:version |v\.? ?)?1\.0", "Common Public License Version 1.0"),
    (3, "artistic", "artistic", r"artistic licen[cs]e (?:version |v\.? ?)?[12]\.0", "Artistic License 2.0"),
    (3, "cc-by", "cc", r"cc by [1234]\.[05]", "CC BY 4.0"),
    (3, "cc-by-sa", "cc", r"cc by sa [1234]\.[05]", "CC-BY-SA 3.0"),
    (3, "cc-by-nc", "cc", r"cc by nc(?: (?:sa|nd))? [1234]\.[05]", "CC BY-NC-ND 4.0"),
    (3, "cc-by-nd", "cc", r"cc by nd [1234]\.[05]", "CC BY-ND 4.0"),
    (3, "cc0", "cc0", r"cc0 1\.0(?: universal)?", "CC0 1.0 Universal"),
    (3, "eupl", "eupl", r"eupl ?(?:v\.? ?)?1\.[012]", "EUPL v1.2"),
    (3, "php", "php", r"php licen[cs]e (?:version |v\.? ?)[23]\.[0-9]{1,2}", "The PHP License, version 3.01"),
    (3, "psf", "psf", r"psf licen[cs]e (?:agreement|version [0-9])", "PSF License Agreement for Python 3"),
    (3, "ofl", "open font", r"(?:sil )?open font licen[cs]e (?:version |v\.? ?)?1\.[01]", "SIL Open Font License 1.1"),
    (3, "busl", "business source", r"business source licen[cs]e (?:version |v\.? ?)?1\.[01]", "Business Source License 1.1"),
    (3, "afl", "academic free", r"academic free licen[cs]e (?:version |v\.? ?)?[123]\.[012]", "Academic Free License v. 2.1"),
    (3, "osl", "open software", r"open software licen[cs]e (?:version |v\.? ?)?[123]\.[01]", "Open Software License 3.0"),
    (3, "elastic", "elastic license", r"elastic licen[cs]e (?:version |v\.? ?)?[12]\.0", "Elastic License 2.0"),
    (3, "mulan", "mulan", r"mulan (?:psl|permissive software licen[cs]e)(?: v(?:ersion)? ?[12])", "Mulan PSL v2"),
    (3, "nasa", "nasa", r"nasa open source agreement (?:version |v\.? ?)?1\.[0-9]", "NASA Open Source Agreement version 1.3"),
    (3, "rpl", "reciprocal public", r"reciprocal public licen[cs]e (?:version |v\.? ?)?1\.[0-9]", "Reciprocal Public License 1.5"),
    (3, "cpal", "common public attribution", r"common public attribution licen[cs]e (?:version |v\.? ?)?1\.0", "Common Public Attribution License Version 1.0"),
    (3, "zope", "zope", r"zope public licen[cs]e (?:zpl )?(?:version |v\.? ?)?[12]\.[01]", "Zope Public License (ZPL) Version 2.1"),
    (3, "zend", "zend", r"zend licen[cs]e (?:version |v\.? ?)?2\.[0-9]{1,2}", "The Zend License, version 2.00"),
    (3, "hippocratic", "hippocratic", r"hippocratic licen[cs]e (?:version |v\.? ?)?[123]\.[0-9]", "Hippocratic License Version 2.1"),
    (3, "openldap", "openldap", r"openldap public licen[cs]e (?:version |v\.? ?)?[12]\.[0-9]", "The OpenLDAP Public License Version 2.8"),
    (3, "apsl", "apple public", r"apple public source licen[cs]e (?:version |v\.? ?)?[12]\.[0-2]", "Apple Public Source License Version 2.0"),
    (3, "cdla", "community data", r"community data licen[cs]e agreement (?:permissive|sharing) (?:version |v\.? ?)?[12]\.0", "Community Data License Agreement - Permissive - Version 2.0"),
    (3, "blueoak", "blue oak", r"blue oak model licen[cs]e 1\.0(?:\.0)?", "Blue Oak Model License 1.0.0"),
    (3, "cern-ohl", "cern", r"cern open hardware licen[cs]e (?:version |v\.? ?)?[12](?:\.[0-2])?", "CERN Open Hardware Licence Version 2"),
    (3, "ogl", "open government", r"open government licen[cs]e (?:version |v\.? ?)?[123](?:\.0)?", "Open Government Licence v3.0"),
    # --- plain titles ---
    (2, "imagemagick", "imagemagick", r"imagemagick licen[cs]e", "the ImageMagick License"),
    (2, "qpl", "public licen", r"(?:the )?q public licen[cs]e", "the Q Public License"),
    (2, "sleepycat", "sleepycat", r"sleepycat (?:public )?licen[cs]e", "The Sleepycat License"),
    (2, "lppl", "latex project", r"latex project public licen[cs]e", "LaTeX Project Public License"),
    (2, "zope", "zope", r"zope public licen[cs]e", "Zope Public License"),
    (2, "ubuntu-font", "ubuntu font", r"ubuntu font licen[cs]e", "Ubuntu Font Licence"),
    (2, "polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter|free trial) licen[cs]e", "PolyForm Noncommercial License"),
    (2, "watcom", "watcom", r"(?:sybase )?open watcom public licen[cs]e", "Sybase Open Watcom Public License"),
    (2, "etalab", "licence ouverte", r"licence ouverte", "Licence Ouverte / Open Licence"),
    (2, "rail", "open rail", r"(?:creativeml )?open rail ?[ms]", "CreativeML Open RAIL-M"),
    (2, "solderpad", "solderpad", r"solderpad (?:hardware )?licen[cs]e", "Solderpad Hardware License"),
    (2, "free-art", "free art", r"free art licen[cs]e", "Free Art License"),
    (2, "opl", "open publication", r"open publication licen[cs]e", "Open Publication License"),
    (2, "freetype", "freetype", r"freetype (?:project )?licen[cs]e", "The FreeType Project LICENSE"),
    (2, "mit", "mit", r"(?:the )?mit licen[cs]e(?: mit)?", "The MIT License (MIT)"),
    (2, "mit", "expat", r"expat licen[cs]e", "the Expat License"),
    (2, "mit", "x11", r"(?:mit )?x11 licen[cs]e", "MIT/X11 license"),
    (2, "mit", "no attribution", r"mit no attribution", "MIT No Attribution"),
    (2, "apache", "apache", r"apache(?: software)? licen[cs]e", "Apache Software License"),
    (2, "gpl", "general public", r"gnu general public licen[cs]e", "GNU GENERAL PUBLIC LICENSE"),
    (2, "gpl", "gpl", r"gnu gpl", "the GNU GPL"),
    (2, "lgpl", "general public", r"gnu (?:lesser|library) general public licen[cs]e", "GNU Lesser General Public License"),
    (2, "agpl", "affero", r"(?:gnu )?affero general public licen[cs]e", "Affero General Public License"),
    (2, "gfdl", "free documentation", r"gnu free documentation licen[cs]e", "GNU Free Documentation License"),
    (2, "bsd", "bsd", r"bsd(?: style)? licen[cs]e", "a BSD-style license"),
    (2, "mpl", "mozilla", r"mozilla public licen[cs]e", "Mozilla Public License"),
    (2, "epl", "eclipse", r"eclipse public licen[cs]e", "Eclipse Public License"),
    (2, "cddl", "common development", r"common development and distribution licen[cs]e", "Common Development and Distribution License"),
    (2, "cpl", "public licen", r"(?:common|ibm) public licen[cs]e", "IBM Public License"),
    (2, "isc", "isc", r"isc licen[cs]e", "ISC License"),
    (2, "zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", "the zlib license"),
    (2, "boost", "boost software", r"boost software licen[cs]e", "Boost Software License"),
    (2, "artistic", "perl", r"perl artistic licen[cs]e", "the Perl Artistic License"),
    (2, "cc-by-sa", "creative commons", r"creative commons attribution share ?alike", "Creative Commons Attribution-ShareAlike"),
    (2, "cc-by-nc", "creative commons", r"creative commons attribution non ?commercial", "Creative Commons Attribution-NonCommercial"),
    (2, "cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative)?s?", "Creative Commons Attribution-NoDerivs"),
    (2, "cc-by", "creative commons", r"creative commons attribution(?: licen[cs]e)?", "Creative Commons Attribution License"),
    (2, "cc0", "creative commons", r"creative commons zero", "Creative Commons Zero"),
    (2, "eupl", "european union", r"european union public licen[cs]e", "European Union Public Licence"),
    (2, "psf", "python software", r"python software foundation licen[cs]e", "Python Software Foundation License"),
    (2, "openssl", "openssl", r"(?:openssl|ssleay) licen[cs]e", "the OpenSSL License"),
    (2, "ofl", "open font", r"sil open font licen[cs]e", "SIL Open Font License"),
    (2, "odbl", "open database", r"open database licen[cs]e", "Open Database License (ODbL)"),
    (2, "ms-pl", "microsoft", r"microsoft public licen[cs]e", "Microsoft Public License"),
    (2, "ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e", "Microsoft Reciprocal License"),
    (2, "sspl", "server side", r"server side public licen[cs]e", "Server Side Public License"),
    (2, "busl", "business source", r"business source licen[cs]e", "Business Source License"),
    (2, "postgresql", "postgresql", r"postgresql licen[cs]e", "The PostgreSQL License"),
    (2, "beerware", "beer", r"(?:the )?beer ?ware licen[cs]e", '"THE BEER-WARE LICENSE"'),
    (2, "ncsa", "ncsa", r"ncsa open source licen[cs]e", "NCSA Open Source License"),
    (2, "w3c", "w3c", r"w3c ?®? ?software (?:and document )?(?:notice and )?licen[cs]e", "W3C Software Notice and License"),
    (2, "commons-clause", "commons clause", r"commons clause", "with the Commons Clause"),
    # --- mentions in fields ---
    (1, "mit", "mit", FIELD + r"(?:the )?mit", 'license = "MIT"'),
    (1, "apache", "apache", FIELD + r"apache(?:-2\.0| 2\.0)?", '"license": "Apache-2.0"'),
    (1, "gpl", "gpl", FIELD + r"(?:gnu )?gpl(?:-?v?[123](?:\.0)?)?(?:-only|-or-later|\+)?", "License: GPL-3.0-or-later"),
    (1, "lgpl", "lgpl", FIELD + r"(?:gnu )?lgpl(?:-?v?[23](?:\.[01])?)?(?:-only|-or-later|\+)?", "License: LGPLv3+"),
    (1, "agpl", "agpl", FIELD + r"(?:gnu )?agpl(?:-?v?3(?:\.0)?)?(?:-only|-or-later|\+)?", "license: AGPL-3.0"),
    (1, "bsd", "bsd", FIELD + r"(?:(?:new|simplified|[234] clause) )?bsd(?:-[234]-clause)?", 'license="BSD"'),
    (1, "mpl", "mpl", FIELD + r"mpl(?:-?[12]\.[01])?", "license: MPL-2.0"),
    (1, "epl", "epl", FIELD + r"epl(?:-?[12]\.0)?", "license: EPL-2.0"),
    (1, "isc", "isc", FIELD + r"isc", '"license": "ISC"'),
    (1, "zlib", "zlib", FIELD + r"zlib", "license: zlib"),
    (1, "boost", "bsl", FIELD + r"bsl-1\.0", "license: BSL-1.0"),
    (1, "artistic", "artistic", FIELD + r"artistic-[12]\.0", "license: Artistic-2.0"),
    (1, "unlicense", "unlicense", FIELD + r"(?:the )?unlicense", "license: Unlicense"),
    (1, "wtfpl", "wtfpl", FIELD + r"wtfpl", '"license": "WTFPL"'),
    (1, "cc0", "cc0", FIELD + r"cc0(?:-1\.0)?", "license: CC0-1.0"),
    (1, "cc-by", "cc", FIELD + r"cc by(?: [1234]\.[05])?(?!-(?:sa|nc|nd))", "license: cc-by-4.0"),
    (1, "cc-by-sa", "cc", FIELD + r"cc by sa(?: [1234]\.[05])?", "license: cc-by-sa-4.0"),
    (1, "cc-by-nc", "cc", FIELD + r"cc by nc(?: (?:sa|nd))?(?: [1234]\.[05])?", "license: cc-by-nc-sa-4.0"),
    (1, "psf", "psf", FIELD + r"(?:psf|python software foundation)", "License: PSF"),
    (1, "ofl", "ofl", FIELD + r"ofl(?:-1\.1)?", "license: OFL-1.1"),
    (1, "mit", "osi approved", r"licen[cs]e osi approved mit licen[cs]e", "License :: OSI Approved :: MIT License"),
    (1, "apache", "osi approved", r"licen[cs]e osi approved apache software licen[cs]e", "License :: OSI Approved :: Apache Software License"),
    (1, "bsd", "osi approved", r"licen[cs]e osi approved bsd licen[cs]e", "License :: OSI Approved :: BSD License"),
    (1, "gpl", "osi approved", r"licen[cs]e osi approved gnu general public licen[cs]e", "License :: OSI Approved :: GNU General Public License v3 (GPLv3)"),
    (1, "proprietary", "proprietary", FIELD + r"proprietary", "License: Proprietary"),
    (1, "proprietary", "all rights reserved", r"all rights reserved", "All rights reserved"),
)

#: What a blank of an expression stands for; it holds no letter or digit, so it is never given back.
GAP = r"""(?:[\s*#/;:,.()\[\]"'`<>=|_&–—-]++)"""


@dataclass(frozen=True)
class Signature:
    priority: int  # higher goes first
    confidence: float
    label: str
    pattern: re.Pattern[str]
    keywords: tuple[str, ...]  # all of them are in every match
    example: str


def signatures() -> list[Signature]:
    """All rules, in order of priority; expressions with their gaps, between word boundaries."""
    out = []
    for priority, label, keyword, expression, example in _TEXT:
        pattern = re.compile(rf"(?<![a-z0-9]){expression.replace(' ', GAP)}(?![a-z0-9])", re.DOTALL)
        keywords = (keyword, "licen") if re.search(r"licen(?:\[cs\]e|se)", re.sub(r"\((?:[^()]|\([^()]*\))*\)\??", "", expression)) else (keyword,)
        out.append(Signature(priority, CONFIDENCE[priority], label, pattern, keywords, example))
    return out

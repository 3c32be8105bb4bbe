"""Digests (``license_scan.text_key``) of full licence texts: the usual wordings, with and without title and appendix."""

# Fixed values, by licence.
DIGESTS = {
    "Apache-2.0": [
        "0f994dc356957877073197b25cd2ee08f622834b931478df4b6700855ca2c73e",
        "37599287c15c2f2ec060c3c3b55bdf69e3bc7a8aeeb9cd57e18800088789538a",
        "769f6cd740fe13ac62c8d735e4f75a44231f944dc392325d819290d7fb6b07e1",
        "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184",
        "c8c1d61893fe269118117851f26d10ecc4931f1d7673e4e2d580818016971c8c",
        "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2",
        "f25c5e5354b250234b3582ef2d0acbde91c5ca8e59fd7c86bcdd5d2ca781e825",
        "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0",
    ],
    "BSD-2-Clause": [
        "117fa84a7ffb2cb3a2ba7d18dd284e7283b034d6fb6c6419721ee4e28b5306fe",
        "23d7258e25bd67982ccec4b5bfc05631a20f8ee5bd5fe7eb70694c100aae88d2",
        "3d373de92836de19d92321fc361f923ef6f5201203c684347ef34c6dea41e082",
        "3e6e67ce95c3908b9432338a5efeb9b6f394043d562b706d2bd6059653b20127",
        "43f78ea19af9f7bd50c9abb06e1bcd952852d282f80770775ab4ab9a69885b85",
        "447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2",
        "4a494feea57c89b1d2df1d000ab333a8ea5269368477822627e057affa1b1503",
        "6a5d49c15e02e9e94957d78177d86e8631be9a19549a7cfd2e8c3be2699f00b9",
        "7be8178e4e9d0dea6ff4b04bd52bd086d7ea8386a5a6e09760df916bae5d42d2",
        "8690799a97c1655f70ca1377fa79cb2563065346e1e5c221ba6cb8eb0a7e7089",
        "986c3c3199a93b916c8f2e0aeed57819bcbdcb2cd9d99902dcc9d74b53f93a74",
        "98f6040d29d99951327788fe49ec14e13e6f01de66bd7d41e878f924efd9ad08",
        "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30",
        "b070fd5d70d88d2dc201bf62e27cd5c1a36261a7b51912e5e4f044a2081fc2be",
        "b265945940ccdc41492a8c56728fe75bfaf767b67d176e33b2649c7dcf426893",
        "b6093f80a67d752fa17301d7c8f20fe906e6f11169f3a64f9a5816d148eb738f",
        "c5de8b3e509aa988368d53d3c534a0bbe581f146f6c4a738bdae32e1006533ab",
        "dfb735646da984cb814b2aab18aef097d6e575950073bd82353f618e44014642",
        "e90608a663ae638023eb95a6ae359f7b6b865e6237fa832c48500c4e1af035b9",
        "f9c0de945db946a0b06e8587a80b1b35b3f3e48a0f63cb64860eb4e433d32c7b",
    ],
    "BSD-3-Clause": [
        "002ce4b8f1abc08327f935f87bf49584f7fc46fe8139a530cb4ce445fad613c6",
        "01d73ce372859c0b7742179e81bea6290edd7c04a025bae36a1d7f592c1c60f3",
        "06ad45966a561f59829f3496a1ae5a8531e12bb8891f87d10370de9e97beb789",
        "0af6267f495661a9c4f72f474602031f4e40485e3f4d0ab8e79bb5cc1c3f507f",
        "0fbd7c43c4bb3e398d262b8e39f58ee0a8709a2b3b6b4bee4e033b3d5755f58d",
        "18f54b0e78943ceaf75779ea906003b2d6d88c78c95ef9ce5290a8343736cb9b",
        "1e19c82feee49e15b91a1b4e958277657cd69675f24fe67aa7c4b65222fc0542",
        "2197427e156dd704210ae726a3807f7deae35bc31d7243168c575348f6a5419b",
        "34e24d5332142fabdf73dcb36195363aea85fb1d345eea11b62af8669fdd2ab4",
        "36320377bc712df0228f7cd02a978b1639d095cf14c52e5a4eba4e1b3f56ca0c",
        "37bf45805f7938f8ac7ce16ea5318d45854ddb4a16e1fc07d8069312fc95a345",
        "3e014774c93dc06782551a2b8446ab6dc76298681a17e12bc36bb08a2c9aa4de",
        "526279aa5ce65fb23ffd45ae5430abc95af7bd6118ff94cc2842185ce6aa2c02",
        "6879a2e5a31cfbe41662378bd0e807b54603e40ba10bfbeb55484d803ae67da2",
        "6a794051fca3bb53638164340f6c2263e652d548fea0d01b009536b223272ba1",
        "6aee8940ea49459164467e0c55499b7e92ac4571618b9b9e538745b2c40761ff",
        "6b6f61212471dad664814ef5c27a6537e3680d0ed0f134cca1988fcc7e14bb68",
        "6d1ffc01587f0e5352d195eca577a1888d2848f27c8398b7fffc58db06a4a8c3",
        "73a15ef51d0f74bce7fc4d1287b8d8a639c37581de7f63863957aea115dca7da",
        "743e0dce69ddf1a88517ba9cc8ccc4077bb79a9fa5f10abd9548df0a7ac10b88",
        "75f5952b514d226c74cc7ef095cd3590ded08c550c2cfb027b81e658b77df0b2",
        "7eee97f85c968143b39a8c496e2507c458c68de0e045426e2a6a5b4f981c2576",
        "820761e820140e1fb3fdba2f5c12794e1a1839d63a24f3cd527a2b10e4136d22",
        "84e4bc272166247a870541de152ff4a41ca3a713757da1d6ef794da21bedd899",
        "8d64a851c523b4ac4810a5b3436c9a39eb6230d005f04c93629f6a504361e698",
        "8ea8b8d56b60a1c8c3272bd44402057aa62f99b6d36d425e8659eed020e2f756",
        "9887afc31f7cbdc577817f3f986cc9321234d0374b991eb853f5160d4d1ee566",
        "9ac2a8d687f8f027199caeb75375c6df77a9682afac572cb60e9731941c458f2",
        "9b4633196b7dae6e8c40f0e853765e57a9db9f4360f741f5b79bd26964099070",
        "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2",
        "b6ab7953b6c80a72261014244324a70663f1807fa212f52461b24c95eb16b4a9",
        "bb9673c5222873ae20b44ed8adee0126945a8168f2e943b5cf751ffd142f5f76",
        "bca73963099dc5bc5578cbd00c6f7eb128282dba680663baeccf58bced15bb97",
        "c165caf2263156afde96f4b02327c2ba96c47bd8cff887df37a4210399885793",
        "cb64d0760d146cfe8d06a5c476589578f0e92b910a9bf5db13ffaae0c89c677b",
        "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15",
        "d1ecc0a46c23dad7f9e13b19b877e5be7ec9d2b9bb05a2dfde2e47be83438590",
        "d66162fde68aa606d05fe3d7e292054d36850db6e7a0aeab967b036a1fdc430c",
        "da92aade784fb0ae11a162608d8890ddb3fb559407fdf93cf6f6c73c2d40a216",
        "e2da86bd774320290bb29f1cf814fac2f678f99bf5a06176d6b9bb6f11b77f12",
        "ec6cb899c9739580c1def12a1f3d1c159d24f61d34962bcff809cbec981b66b0",
        "f27a77cfff56517aa170b0be7f95b5386537c6735033ad1c64c978a360cb61c1",
        "f6bb09702560ebb6056dc8e8b992df526e0289549856a8f435c5aaff66945b2c",
        "f9e73a12bfcb3b19fb692ede3124994850764615c7242af073bbe9a194c361df",
        "ff803268cdc16a9c66da393d696a6e964bca5dfc859392b730a461345ac274c1",
    ],
    "CC0-1.0": [
        "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    ],
    "GPL-1.0": [
        "74d0cd23803c9754c36f6ca0e1af411b418ed6b6564e757472bf0d870a1b5d1b",
        "99787965f814e5a0c5522ca06ad4b386e1c53dd443f8ca3d07dddf3102b6b302",
        "af30c0af27b90ec812acdb040f3dcc944a87cd893456690efe35063f39e3eeeb",
    ],
    "GPL-2.0": [
        "1551b61aa183f987ecceedd8966ec1e9b2da3848f8862c2adedc0d82f41904ca",
        "39c702bd5e934ba747a73aee50bef73799ecdd08c9e61c47b990c65fbae8d41b",
        "c67cc53030ae25fe2e2f0143b59060eca5ad89da8d2beca1445641234d29fc88",
    ],
    "GPL-3.0": [
        "57f71ba95bda9ddb21fcd4d2b6841fdc3ef7fcebd5c12a2fd2ee5f2027869fc6",
        "5b8bbbc08610f585b26c4d45ec4c46b3a401532b9362524e72b89d9db72bcb4f",
        "6c8c52377729db82bb9a3f7ef0c5a0c40a275aae04390347358fefb1ead807ee",
    ],
    "ISC": [
        "217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a",
        "25a274d52b3014d9bd64e0f3362fd279ac1655f163d5c518f6b9f6c43354802c",
        "30fe7ddd14f7f6d7bce47da437bac0dc1a88496b90a9be0b1bad8404b114c011",
        "370f1168f30f0ef0eaff5dabce21688c84806dee21f6021b35b65e59a9fa9b15",
        "3c094e9c7072025f416c19903d3f8c435095de9b51bfac84d6c57e84483dcee9",
        "40e6eb51c3b409d93549806b55b249c261dab149d19b56cc163624f39a08b1db",
        "4b4705fe294a1053a1641ec537d422fd93b4f1de7a612a5f5c6f8a4243c3f751",
        "5395b82315c3e2e100afb6bef9bf10dd405b46d1898029f0ac2621c2aa8636e2",
        "571c6f1b092916ec5c47890bbd34b8d9b81d53924bf0295cce6fc61732751ea2",
        "c3ea82ab79c0ace8ee0dc4d7d3de805d7e42563710b79e38f0aa2ec7c7713018",
        "edf9eefb56400d380d017c2f59e34f0db5919754c1f73825d3b8ab93c216b0d1",
        "f172f90a892d869d5d840d5f4363218a9b21bdb1bd3925ba9c752d1660134fee",
    ],
    "LGPL-2.0": [
        "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2",
        "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260",
        "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    ],
    "LGPL-2.1": [
        "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4",
        "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
        "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df",
    ],
    "LGPL-3.0": [
        "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    ],
    "MIT": [
        "07a0c98d1dbf0062cedfbb5e38df91d8bd896a09ec198aa53c51fb2115592bd7",
        "0c16f9c6e202d1a21811642f6c5098ab140898c6b3c421fcbe4aa41fb5d92c29",
        "0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c",
        "35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164",
        "4c73df23d587f9f63f7ceaa5724e1023667ba176cc4b35c71e6696e42d6d1143",
        "581c58dda46462468177d8af0224930878c4db1747d8d4e21c1067fb0f753199",
        "5a21006de40799a3566f8ce96d98f8de967ab96e11764f5e9c6e2e669317f741",
        "6ad3654379e72bbdf8478d5c90fb1e2525aba033fbe675e0ef2248aac67c0f6f",
        "6c833965e9ca4cf8095655005226f24fe8bf7b1605dbe513204837a7371fa127",
        "74620107d78b567f655cb06d51f930a5e0e3cd3e1a2478bc7b860e678d8e447b",
        "7c3366b22b9f0d6a198b2c29bd1c4b663b2d55eacbd066146e5476c4b8ff1ce4",
        "9f33a4effeb943e64d0ba48d6b4b4a1e4f1c4ffffddcf14aa94e23b5e3675749",
        "b03957a25ac849d7d093347fbea49f23f1a07bddbbca1b3837e84e9f08827d90",
        "cc9960c60fe2db01bf880b0d9973aa8f363261a4bd254759e317e4bcf79cb747",
        "ce56920e57e65aea4988a3d04f523bdceedd62176f0e66860fba85f85433a29b",
    ],
    "MPL-1.1": [
        "4be4a6251869e153404f424bbd1c116ada60f8969d5610b406e2a430e206b0bc",
    ],
    "MPL-2.0": [
        "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
    ],
    "Unlicense": [
        "41f84c538b3bc6dcfe6afaab48f6e16c34fd1b11b2c6be7db47873ba3bce291a",
        "6077a8a20d606206e486caec85a30b2545701071b1e08d12c37fb9a0e490d1bf",
        "7a4d92cdb11d254973a073803be1148a5402f1b2ca67808cdb3ef78b596102cd",
    ],
    "Zlib": [
        "1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7",
        "99618428d879198d4ae824db7ad07a9d0f9214f15429de52839cbe667713f21a",
        "a5077e3bd5e1fddc16e8af8710c266a83f01fdf5b8008ec357d075ae8185f8b2",
        "ee37bc3ccba61ff28a10c05f28bdabf7466db400a75d9a1890fb865cda23e145",
    ],
}
